"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, line_dedup, lm_score, near_dup, packing, quality_classifier, quality_rules, token_output, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_language_id": language_id.query,
    "op3_quality_classifier": quality_classifier.query,
    "op4_decontaminate": decontaminate.query,
    "op5_toxicity": toxicity.query,
    "op6_lm_score": lm_score.query,
    "op7_token_output": token_output.query,
    "op8_near_dup": near_dup.query,
    "op9_packing": packing.query,
    "op9_packing_tokens": packing.token_query,
    "op10_line_dedup": line_dedup.query,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op8_near_dup": near_dup.ORACLE,
    "op9_packing": packing.ORACLE,
}
