"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, jaccard, langid, lm, ogg, packing, pfor, quality, substrings, token_counts

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_token_counts": token_counts.op3_token_counts,
    "token_counts_by_pattern": token_counts.token_counts_by_pattern,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_ogg_media": ogg.op5_ogg_media,
    "op6_language_id": langid.op6_language_id,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_pfor_token_files": pfor.op8_pfor_token_files,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_benchmark_decontamination": decontam.op10_benchmark_decontamination,
}
ORACLE_SQL = {"token_counts_by_pattern": token_counts.PATTERN_SQL}
