"""Advances of characters in a common proportional face."""

#: Widths of the printable ASCII characters, from the space on, of a common proportional face, in thousandths of an em.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
EM = 16
#: Ranges of code points that take two columns.
WIDE = ((4352, 4447), (11904, 12350), (12353, 42191), (44032, 55203), (63744, 64255), (65072, 65135), (65280, 65376), (65504, 65510), (127744, 129791), (131072, 262141))
