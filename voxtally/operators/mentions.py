"""Theme mentions: which record supports which theme, with its feedback facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally import fixed
from voxtally.functions.exprs import normalize_text, trim_to_null
from voxtally.functions.skew import hashable, key_counts, newest
from voxtally.functions.values import parse_date


def check_feedback(fb: DataFrame) -> None:
    if "feedback_id" not in fb.columns:
        raise KeyError("The feedback table has no feedback_id.")
    if "masked_text" not in fb.columns:
        raise KeyError(fixed.MSG_NEEDS_MASKED_THEMES)


def row_order(df: DataFrame) -> Column:
    """What decides between rows with the same id: the ingest position, else the row's content."""
    return F.col("_row_number") if "_row_number" in df.columns else F.xxhash64(*hashable(df))


def feedback_facts(fb: DataFrame) -> DataFrame:
    """One row per non-blank id (the last one): source, user_type, rating, date, day and a quotable text.

    A quote is the whole masked text, so texts over the quote limit can never
    be one; only short texts travel further.
    """
    check_feedback(fb)

    def optional(name: str) -> Column:
        return trim_to_null(F.col(name).cast("string")) if name in fb.columns else F.lit(None).cast("string")

    rating = F.col("rating").cast("string").try_cast("double") if "rating" in fb.columns else F.lit(None).cast("double")
    text = normalize_text(F.col("masked_text"))
    facts = fb.select(
        trim_to_null(F.col("feedback_id").cast("string")).alias("feedback_id"),
        optional("source").alias("source"),
        optional("user_type").alias("user_type"),
        F.when(~F.isnan(rating), rating).alias("rating"),
        optional("date").alias("date"),
        parse_date(optional("date")).alias("day"),
        F.when(F.length(text) <= fixed.MAX_QUOTE_CHARS, text).alias("quote"),
        row_order(fb).alias("_order"),
    ).where("feedback_id is not null")
    order = F.struct("_order", F.xxhash64("source", "user_type", "rating", "date", "quote").alias("tie"))
    return newest(facts, "feedback_id", order, "source", "user_type", "rating", "date", "day", "quote")


def total_records(fb: DataFrame) -> int:
    """Distinct non-blank ids."""
    ids = fb.select(trim_to_null(F.col("feedback_id").cast("string")).alias("id")).where("id is not null")
    return ids.distinct().count()


def theme_mentions(analysis: DataFrame) -> DataFrame:
    """One row per (theme, record); a record counts once per theme and primary beats secondary.

    Where an id was analysed more than once, the last analysis naming the theme
    supplies severity, confidence and sentiment.  Hot ids are reduced by the
    aggregate before anything is shuffled.
    """
    role = "struct<theme_name:string,is_primary:boolean,severity:string,confidence:double>"
    primary = F.struct(
        F.col("primary_theme").alias("theme_name"), F.lit(True).alias("is_primary"),
        F.col("severity"), F.col("primary_confidence").alias("confidence"),
    ).cast(role)
    secondary = F.transform(
        "secondary_themes",
        lambda s: F.struct(s["theme"].alias("theme_name"), F.lit(False).alias("is_primary"),
                           s["severity"].alias("severity"), s["confidence"].alias("confidence")).cast(role),
    )
    exploded = analysis.select(
        "feedback_id", "sentiment", F.col("confidence").alias("record_confidence"), row_order(analysis).alias("_order"),
        F.explode(F.concat(F.array(primary), F.coalesce(secondary, F.array().cast(f"array<{role}>")))).alias("m"),
    ).where(~F.col("m.theme_name").isin(*fixed.UNCOUNTED_THEMES))
    order = F.struct("_order", "m.is_primary", "m.confidence", "record_confidence", "m.severity", "sentiment")
    last = F.max_by(F.struct("m.severity", "m.confidence", "sentiment", "record_confidence"), order)
    return (
        exploded.groupBy(F.col("m.theme_name").alias("theme_name"), "feedback_id")
        .agg(F.max("m.is_primary").alias("is_primary"), last.alias("last"))
        .select("theme_name", "feedback_id", "is_primary", "last.*")
    )


def mention_table(analysis: DataFrame, fb: DataFrame) -> DataFrame:
    """Mentions joined to the feedback facts; analyses of unknown ids fall away here.

    Both sides hold one row per id (and theme), so the join has no hot key.
    """
    return theme_mentions(analysis).join(feedback_facts(fb), "feedback_id")


def _known_ids(fb: DataFrame) -> DataFrame:
    ids = fb.select(trim_to_null(F.col("feedback_id").cast("string")).alias("feedback_id"))
    return ids.where("feedback_id is not null").distinct()


def exclude_orphans(analysis: DataFrame, fb: DataFrame) -> DataFrame:
    """Analysis rows whose id is in the feedback table."""
    return analysis.join(_known_ids(fb), "feedback_id", "left_semi").select(*analysis.columns)


def orphan_ids(analysis: DataFrame, fb: DataFrame) -> DataFrame:
    """Ids analysed but not in the feedback table, with their row counts and the warning text."""
    counts = key_counts(analysis, "feedback_id", "analysis_rows")
    missing = counts.join(_known_ids(fb), "feedback_id", "left_anti")
    message = F.concat(F.lit(fixed.ORPHAN_BEFORE), F.col("feedback_id"), F.lit(fixed.ORPHAN_AFTER))
    return missing.withColumn("message", message)
