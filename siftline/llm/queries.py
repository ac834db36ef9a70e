"""The queries of this subpackage and, where SQL can state one, equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import (
    chat,
    decontaminate,
    hmm,
    jaccard,
    language,
    packed_products,
    packing,
    permutation,
    quality,
    runs,
    secrets,
    site_lines,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1,
    "op2_lm_scoring": hmm.op2,
    "op3_secret_scans": secrets.op3,
    "op4_quality_classifier": quality.op4,
    "op5_language_id": language.op5,
    "op6_line_dedup": site_lines.op6,
    "op7_nearest_neighbours": permutation.op7,
    "op8_benchmark_decontamination": decontaminate.op8,
    "op9_chat_formatting": chat.op9,
    "op10_ngram_jaccard_join": jaccard.op10,
    "op11_toxicity": toxicity.op11,
    "op12_hard_negatives": packed_products.op12,
    "op13_periodic_runs": runs.op13,
}
SQL: dict[str, str] = {
    "op6_line_dedup": site_lines.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
    "op9_chat_formatting": chat.SQL,
    "op10_ngram_jaccard_join": jaccard.SQL,
    "op12_hard_negatives": packed_products.SQL,
}
