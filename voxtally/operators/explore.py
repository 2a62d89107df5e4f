"""Record-level explorer: safe table, filters, search, preview."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.skew import lookup_join, newest
from voxtally.operators.mentions import row_order

EXPLORER_COLUMNS = (
    "feedback_id", "source", "date", "rating", "sentiment", "primary_theme", "secondary_themes", "severity", "intent",
    "product_area", "confidence", "requires_human_review", "analysis_method", "cluster_id", "pii_detected", "masked_text",
)
SEARCHED = ("feedback_id", "masked_text", "primary_theme", "secondary_themes", "source")
#: The list filters and their columns.
LISTS = {
    "primary_themes": "primary_theme", "sentiments": "sentiment", "severities": "severity", "intents": "intent", "sources": "source", "analysis_methods": "analysis_method",
}


def secondary_names(column: str = "secondary_themes") -> Column:
    return F.array_join(F.transform(column, lambda s: s["theme"]), ", ")


def join_first_feedback(analysis: DataFrame, fb: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each analysis row with the first feedback row of its id; hot ids do not gather in one task.

    Adds ``_found`` and the feedback columns that exist, prefixed with ``fb_``.
    """
    present = [c for c in columns if c in fb.columns]
    absent = {f"fb_{c}": F.lit(None).cast("string") for c in columns if c not in fb.columns}
    own = fb.select(
        F.col("feedback_id").cast("string").alias("feedback_id"),
        *[F.col(c).alias(f"fb_{c}") for c in present],
        row_order(fb).alias("_order"),
    ).where("feedback_id is not null")
    names = [f"fb_{c}" for c in present]
    first = newest(own, "feedback_id", F.struct("_order", *names), *names, first=True).withColumn("_found", F.lit(True))
    return lookup_join(analysis, first, "feedback_id").withColumns(absent)


def explorer_table(analysis: DataFrame, fb: DataFrame) -> DataFrame:
    """The 16 columns that may be shown; raw text is not among them."""
    joined = join_first_feedback(analysis, fb, ("source", "date", "rating", "pii_detected", "masked_text"))
    return joined.select(
        "feedback_id",
        F.col("fb_source").alias("source"),
        F.col("fb_date").alias("date"),
        F.col("fb_rating").alias("rating"),
        "sentiment",
        "primary_theme",
        secondary_names().alias("secondary_themes"),
        "severity",
        "intent",
        "product_area",
        "confidence",
        "requires_human_review",
        "analysis_method",
        "cluster_id",
        F.coalesce(F.col("fb_pii_detected").cast("boolean"), F.lit(False)).alias("pii_detected"),
        F.when(F.col("_found"), F.col("fb_masked_text")).otherwise("").alias("masked_text"),
    )


def search_explorer(df: DataFrame, query: str) -> DataFrame:
    """Rows where any searchable column matches the query as a case-insensitive regex; null never matches."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    columns = [c for c in SEARCHED if c in df.columns]
    tests = [F.coalesce(F.rlike(F.lower(F.col(c)), F.lit(wanted)), F.lit(False)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def filter_explorer(
    df: DataFrame,
    primary_themes: Sequence[str] = (),
    sentiments: Sequence[str] = (),
    severities: Sequence[str] = (),
    intents: Sequence[str] = (),
    sources: Sequence[str] = (),
    human_review: str | None = None,
    pii_detected: str | None = None,
    analysis_methods: Sequence[str] = (),
    search_query: str = "",
) -> DataFrame:
    """All given filters together; an empty list or None means no filter, ``Yes``/``No`` for the flags."""
    for name, wanted in (("primary_themes", primary_themes), ("sentiments", sentiments), ("severities", severities), ("intents", intents),
                         ("sources", sources), ("analysis_methods", analysis_methods)):
        if wanted:
            df = df.where(F.col(LISTS[name]).isin(*wanted))
    for column, answer in (("requires_human_review", human_review), ("pii_detected", pii_detected)):
        if answer in ("Yes", "No"):
            df = df.where(F.col(column) if answer == "Yes" else ~F.col(column))
    return search_explorer(df, search_query)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows."""
    return df.limit(rows)


