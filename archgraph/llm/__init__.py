"""Operators that prepare training corpora. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archgraph.llm import bpe, html_text, line_dedup, media, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_media_columns": media.op5_media_columns,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_html_extraction": html_text.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested in tests/llm."""
    return {
        "op1_minhash_near_dedup": near_dedup.OP1_SQL,
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op7_suffix_array_dedup": suffix_dedup.OP7_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
    }
