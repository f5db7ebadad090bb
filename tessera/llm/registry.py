"""Queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from tessera.llm import decontamination, html_extraction, jaccard_join, lexical_search, lm_scoring, packing, quality, seed_extend, sharding, substring_dedup, token_counts, url_filter, valid_time

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_packing": packing.op3_packing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_quality": quality.op7_quality,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_seed_extend": seed_extend.op12_seed_extend,
    "op13_valid_time": valid_time.op13_valid_time,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op7_quality": quality.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_seed_extend": seed_extend.ORACLE,
    "op13_valid_time": valid_time.ORACLE,
}
