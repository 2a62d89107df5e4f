"""Display metrics of insights, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally import fixed
from voxtally.functions.exprs import keep, round_half_even, string_map


def _count(distribution: str, label: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(distribution), F.lit(label)), F.lit(0))


def impact_level() -> Column:
    severe = (_count("severity_distribution", "critical") > 0) | (_count("severity_distribution", "high") > 0)
    unhappy = F.coalesce(F.col("average_rating") <= 2.5, F.lit(False))
    return (
        F.when(severe | unhappy, "High").when(_count("severity_distribution", "medium") > 0, "Medium").otherwise("Low")
    )


def urgency(impact: Column | None = None) -> Column:
    impact = impact if impact is not None else impact_level()
    many = F.col("mention_count") >= fixed.STRONG_MIN_MENTIONS
    return (
        F.when((impact == "High") & many, "P0 Critical")
        .when((impact == "High") | ((impact == "Medium") & many), "P1 High")
        .when(impact == "Medium", "P2 Medium")
        .otherwise("P3 Low")
    )


def _title(slug: Column) -> Column:
    return F.initcap(F.trim(F.replace(slug, F.lit("_"), F.lit(" "))))


def theme_label(theme: Column) -> Column:
    return F.when(F.coalesce(theme, F.lit("")).isin("", "unknown"), "Unknown").otherwise(_title(theme))


def status_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(string_map(fixed.REVIEW_STATUS_LABELS), status), _title(status))


def evidence_label(strength: Column) -> Column:
    return F.initcap(strength)


def format_distribution(counts: DataFrame, kind: str, themes: DataFrame | None = None) -> DataFrame:
    """``theme_name, text``: ``k: v, k: v`` by key from the distribution table; a dash for a theme of ``themes`` without any.

    The text has an entry for each distinct value of a theme, not for each record.
    """
    pair = F.struct("value", F.concat("value", F.lit(": "), F.col("records").cast("string")).alias("said"))
    listed = F.array_sort(F.collect_list(pair))
    text = F.array_join(F.transform(listed, lambda p: p["said"]), ", ")
    shown = counts.where(F.col("kind") == kind).groupBy("theme_name").agg(text.alias("text"))
    if themes is None:
        return shown
    return themes.select("theme_name").join(shown, "theme_name", "left").select("theme_name", F.coalesce("text", F.lit("—")).alias("text"))


def short_explanation(theme: Column) -> Column:
    generic = F.concat(F.lit(fixed.GENERIC_EXPLANATION), F.lower(theme_label(theme)), F.lit("."))
    return F.coalesce(F.get("possible_root_causes", F.lit(0)), generic)


def insight_warnings() -> Column:
    """The insight's own warnings plus what its numbers call for."""
    review = F.size(F.filter("evidence_quotes", lambda q: q["validation_status"] == "requires_review"))
    extra = keep(
        F.when(F.col("evidence_strength") == "weak", fixed.WARN_WEAK),
        F.when(F.col("confidence") < fixed.REVIEW_BELOW_CONFIDENCE, fixed.WARN_LOW_CONFIDENCE),
        F.when(F.col("mention_count") < fixed.MODERATE_MIN_MENTIONS, fixed.WARN_FEW),
        F.when(review > 0, F.concat(review.cast("string"), F.lit(fixed.QUOTES_TO_REVIEW))),
    )
    return F.concat("warnings", extra)


def valid_quote_count() -> Column:
    return F.size(F.filter("evidence_quotes", lambda q: q["validation_status"] == "valid"))


def insights_table(ranked: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Display rows of prioritised insights; a stored decision overrides the status."""
    if decisions is not None:
        chosen = decisions.select(F.col("theme_name"), F.col("status").alias("_status"))
        ranked = ranked.join(chosen, "theme_name", "left")
        status = F.coalesce("_status", "human_review_status")
    else:
        status = F.col("human_review_status")
    return ranked.select(
        "theme_name",
        theme_label(F.col("theme_name")).alias("theme_label"),
        round_half_even(F.col("priority_score"), 4).alias("priority_score"),
        "mention_count",
        "primary_count",
        "secondary_count",
        round_half_even(F.col("feedback_percentage"), 1).alias("feedback_percentage"),
        "average_rating",
        "evidence_strength",
        round_half_even(F.col("confidence"), 3).alias("confidence"),
        status.alias("human_review_status"),
        valid_quote_count().alias("valid_quotes"),
        F.col("mention_count").alias("supporting_ids"),
        F.size("warnings").alias("warnings_count"),
    ).orderBy(F.desc("priority_score"), F.desc("mention_count"), "theme_name")


def evidence_warning_count(warnings: DataFrame, invalid_quotes: int = 0) -> DataFrame:
    return warnings.agg((F.count_distinct("message") + F.lit(invalid_quotes)).alias("evidence_warnings"))


def overview_stats(insights: DataFrame, total: int) -> DataFrame:
    return insights.agg(
        F.lit(total).cast("long").alias("customer_responses"),
        F.count(F.lit(1)).alias("issues_identified"),
        F.count_if(impact_level() == "High").alias("high_impact_issues"),
        F.count_if(F.col("evidence_strength").isin("strong", "moderate")).alias("evidence_backed_issues"),
    )


def theme_detail_metrics(mentions: DataFrame) -> DataFrame:
    """Negative and severe mentions and the top source (first name on ties), from the mention table."""
    sources = mentions.groupBy("theme_name", F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("severe"),
    )
    return sources.groupBy("theme_name").agg(
        F.sum("negative").alias("negative_mentions"),
        F.sum("severe").alias("severe_mentions"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("source"))).alias("best"),
    ).select("theme_name", "negative_mentions", "severe_mentions", F.col("best.source").alias("top_source"))
