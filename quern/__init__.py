"""quern: DataFrame operators for binary shapes and character-art text corpora."""
