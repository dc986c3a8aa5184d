"""The queries of this package by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lakeloom.llm import decontamination, hard_negatives, html_text, language_id, license_scan, ngram_join, quality_classifier, quality_rules, source_mix, substring_dedup, token_alignment, token_counts, token_files

_QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_source_mix": source_mix.op7_source_mix,
    "op8_html_text": html_text.op8_html_text,
    "op9_language_id": language_id.op9_language_id,
    "op10_token_files": token_files.op10_token_files,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
_QUERIES["pipeline"] = corpus_pipeline.run
_ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_quality_classifier": quality_classifier.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op7_source_mix": source_mix.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return _ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
