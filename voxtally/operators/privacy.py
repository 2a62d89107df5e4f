"""Masking of feedback tables and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtally import fixed
from voxtally.functions import pii
from voxtally.functions.exprs import settle


def detect_pii(df: DataFrame, column: str = "feedback_text") -> DataFrame:
    """Adds the full detection result as columns."""
    if column not in df.columns:
        raise KeyError(f"There is no column '{column}' to look for personal data in.")
    text = F.col(column).cast("string")
    spans = settle(df, _spans=pii.pii_resolve(pii.pii_candidates(text)))
    missing = pii.is_missing(text)
    found = F.coalesce(F.size("_spans"), F.lit(0)) > 0
    return spans.withColumns(
        {
            "original_text": F.when(missing & text.isNotNull(), "").otherwise(text),
            "masked_text": pii.pii_mask(text, F.col("_spans")),
            "pii_detected": found,
            "pii_entity_types": pii.pii_entity_types(F.col("_spans")),
            "entities": pii.pii_entities(F.col("_spans")),
            "pii_warning": F.when(missing, fixed.MSG_PII_MISSING),
            "pii_review_required": pii.pii_review_required(F.col("_spans")),
        }
    ).drop("_spans")


def mask_pii(df: DataFrame, column: str = "feedback_text") -> DataFrame:
    """Adds ``masked_text`` only."""
    return detect_pii(df, column).select(*df.columns, "masked_text")


def mask_feedback(df: DataFrame, column: str = "feedback_text") -> DataFrame:
    """Adds original_text, masked_text, pii_detected, pii_entity_types, pii_review_required."""
    return detect_pii(df, column).drop("entities", "pii_warning")


def safe_columns(df: DataFrame) -> DataFrame:
    """Without the raw text columns: what analysis, caches and sinks may see."""
    return df.drop(*fixed.FORBIDDEN_EXPORT_COLUMNS)


def pii_type_counts(masked: DataFrame) -> DataFrame:
    """Records per type of personal data."""
    return (
        masked.select(F.explode("pii_entity_types").alias("entity_type"))
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy("entity_type")
    )


def pii_summary(masked: DataFrame) -> DataFrame:
    return masked.agg(
        F.count(F.lit(1)).alias("records_checked"),
        F.count_if("pii_detected").alias("records_with_pii"),
        F.count_if("pii_review_required").alias("records_requiring_review"),
    )
