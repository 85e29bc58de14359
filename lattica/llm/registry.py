"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, hard_negatives, html_extraction, language, line_dedup, ngram_join, packing, pii, quality, resampling, sharding, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "pii_base": pii.pii_base,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_sharding": sharding.op8_sharding,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_language_id": language.op10_language_id,
    "language_of_pages": language.language_of_pages,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_quality": quality.op12_quality,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "pii_base": pii.BASE_SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op9_ngram_join": ngram_join.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_resampling": resampling.SQL,
}
