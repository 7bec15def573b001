"""The queries of this subpackage and the SQL for those that SQL can express."""

from quern.llm import bpe, decontaminate, jaccard_join, kneser_ney, line_dedup, piece_spans, quality, search, sharding, spelling, token_files, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_bpe": bpe.op9_bpe,
    "op10_lm_scoring": kneser_ney.op10_lm_scoring,
    "op11_sentencepiece": piece_spans.op11_sentencepiece,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op12_ranked_search": search.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
