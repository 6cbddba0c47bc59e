"""The operators as registered queries, with their comparison SQL where SQL can say it."""

from __future__ import annotations

from . import (
    decontaminate, embedding_dedup, exact_dedup, langid, lm_score, ngram_join, packing, resample, search,
    secret_scan, substring_dedup, toxicity, warc,
)

QUERIES = {
    "op1_secret_scans": secret_scan.op1_secret_scans,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_language_id": langid.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_warc": warc.op8_warc,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_lm_scoring": lm_score.op10_lm_scoring,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_embedding_near_dedup": embedding_dedup.op13_embedding_near_dedup,
}
ORACLE = {
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op11_ranked_search": search.SQL,
    "op12_importance_resampling": resample.SQL,
    "op13_embedding_near_dedup": embedding_dedup.SQL,
}
