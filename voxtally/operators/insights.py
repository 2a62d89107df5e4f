"""Theme insights: counts, distributions, trends, strength, and their ranking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxtally import fixed
from voxtally.functions.exprs import keep, round_half_even, string_map
from voxtally.operators.mentions import mention_table, orphan_ids, total_records
from voxtally.operators.quotes import QUOTE_TYPE, representative_quotes
from voxtally.session import stage
from voxtally.sources.taxonomy import DEFAULT_PRESET, lexicon, load_rules

@dataclass
class Aggregation:
    """``insights`` is one row per theme; the other tables are the complete long forms.

    ``distributions`` holds all counts per theme, kind (sentiment, severity, source, segment, day) and value.  Sources and
    segments are free texts of any number, so they are rows at every size and never a value of the insight row.
    """

    insights: DataFrame
    mentions: DataFrame
    distributions: DataFrame
    orphans: DataFrame
    total: int
    warnings: DataFrame
    invalid_quotes: int = 0

    @cached_property
    def excluded(self) -> int:
        """Analysis rows whose id is not in the feedback table; counted on first use."""
        return self.orphans.agg(F.coalesce(F.sum("analysis_rows"), F.lit(0)).alias("n")).first().n


# --- per-theme aggregates over the mention table ----------------------------


def theme_counts(mentions: DataFrame, total: int) -> DataFrame:
    count = F.count(F.lit(1))
    first = F.count_if("is_primary")
    return mentions.groupBy("theme_name").agg(
        first.alias("primary_count"), (count - first).alias("secondary_count"), count.alias("mention_count"),
        _percentage(count, total).alias("feedback_percentage"),
    )


def _percentage(count: Column, total: int) -> Column:
    return round_half_even(count / F.lit(float(total)) * 100.0, 2) if total else F.lit(0.0)


def theme_avg_confidence(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("theme_name").agg(round_half_even(F.avg("confidence"), 3).alias("average_confidence"))


def theme_avg_rating(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("theme_name").agg(round_half_even(F.avg("rating"), 3).alias("average_rating"))


def distribution(mentions: DataFrame, column: str) -> DataFrame:
    """Rows per theme and value; a missing value counts as ``unknown``."""
    value = F.coalesce(F.col(column), F.lit("unknown")).alias("value")
    return mentions.groupBy("theme_name", value).agg(F.count(F.lit(1)).alias("records"))


def theme_date_range(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("theme_name").agg(_day(F.min("day")).alias("start_date"), _day(F.max("day")).alias("end_date"))


def theme_trend(mentions: DataFrame) -> DataFrame:
    """Mentions per theme and day, for records with a readable date."""
    days = mentions.where("day is not null").groupBy("theme_name", "day").agg(F.count(F.lit(1)).alias("records"))
    return days.select("theme_name", _day(F.col("day")).alias("day"), "records")


def theme_feedback_ids(mentions: DataFrame) -> DataFrame:
    """Supporting ids, one row each: the list grows with the data and is never gathered into one value."""
    return mentions.select("theme_name", "feedback_id")


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- texts and labels -------------------------------------------------------


def evidence_strength(
    mentions: Column, quotes: Column, confidence: Column, known_sources: Column, warnings: Column
) -> Column:
    """``known_sources``: distinct sources other than ``unknown``; two or more need not be told apart."""
    broad = (known_sources >= fixed.STRONG_MIN_SOURCES) | (known_sources == 0)
    return (
        F.when(mentions <= fixed.WEAK_MAX_MENTIONS, "weak")
        .when((quotes == 0) | (warnings > 0), "weak")
        .when(confidence < fixed.PRIMARY_MIN_CONFIDENCE, "weak")
        .when(
            (mentions >= fixed.STRONG_MIN_MENTIONS) & (confidence >= fixed.STRONG_MIN_CONFIDENCE)
            & (quotes >= fixed.STRONG_MIN_QUOTES) & broad,
            "strong",
        )
        .when(mentions >= fixed.MODERATE_MIN_MENTIONS, "moderate")
        .otherwise("weak")
    )


def theme_warnings(mentions: Column, quotes: Column) -> Column:
    return keep(
        F.when(mentions <= fixed.WEAK_MAX_MENTIONS, fixed.MSG_FEW_RECORDS),
        F.when(quotes == 0, fixed.MSG_NO_QUOTES),
    )


def root_causes(theme: Column, mentions: Column) -> Column:
    template = F.coalesce(F.try_element_at(string_map(lexicon()["root_causes"]), theme), F.lit(fixed.GENERIC_ROOT_CAUSE))
    return F.array(
        F.concat(F.lit(fixed.OBSERVED), mentions.cast("string"), F.lit(fixed.MENTIONED),
                 F.replace(theme, F.lit("_"), F.lit(" ")), F.lit(".")),
        F.concat(F.lit(fixed.INTERPRETED), template),
        F.lit(fixed.ROOT_CAUSE_CAVEAT),
    )


def suggested_actions(theme: Column, preset: str = DEFAULT_PRESET) -> Column:
    """Action texts come from the default preset unless another one is asked for."""
    actions = {r["theme"]: r["action"] for r in load_rules(preset) if r["action"]}
    template = F.coalesce(F.try_element_at(string_map(actions), theme), F.lit(fixed.GENERIC_ACTION))
    return F.array(F.concat(F.lit(fixed.SUGGESTED), template), F.lit(fixed.ACTION_CAVEAT))


def insight_pii_flag(insights: DataFrame) -> Column:
    """True where the texts of an insight hold an ``@`` but no mask token at all."""
    parts = F.concat(
        "representative_quotes", F.transform("evidence_quotes", lambda q: q["quote"]),
        "possible_root_causes", "suggested_product_actions",
    )
    blob = F.array_join(parts, " ")
    masked = reduce(lambda a, b: a | b, [F.contains(blob, F.lit(f"[{t}_REDACTED]")) for t in fixed.PII_TYPES])
    return F.contains(blob, F.lit("@")) & ~masked


# --- the insight table ------------------------------------------------------


def _closed_map(column: str, labels) -> Column:
    """Counts per label of a closed set as a key-sorted map, zero counts left out."""
    pairs = F.array(*[F.struct(F.lit(v).alias("k"), F.count_if(F.col(column) == v).alias("n")) for v in sorted(labels)])
    return F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))


def distributions(mentions: DataFrame, has_segments: bool = True) -> DataFrame:
    """``theme_name, kind, value, records`` for every kind of count.  One pass over the mention table, partially aggregated."""
    unknown = F.lit("unknown")
    kinds = {
        "sentiment": F.coalesce("sentiment", unknown), "severity": F.coalesce("severity", unknown),
        "source": F.coalesce("source", unknown), "day": _day(F.col("day")),
        **({"segment": F.coalesce("user_type", unknown)} if has_segments else {}),
    }
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()])).alias("v")
    return (
        mentions.select("theme_name", values).where("v.value is not null")
        .groupBy("theme_name", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("records"))
    )


def build_insights(mentions: DataFrame, total: int, preset: str = DEFAULT_PRESET) -> DataFrame:
    """One row per theme from the mention table, most mentioned first."""
    count, first = F.count(F.lit(1)), F.count_if("is_primary")
    low, high = F.min("source"), F.max("source")
    known = F.when(low.isNull(), 0).when(low == high, 1).otherwise(2)
    core = mentions.withColumn("source", F.when(F.col("source") != "unknown", F.col("source"))).groupBy("theme_name").agg(
        first.alias("primary_count"),
        (count - first).alias("secondary_count"),
        count.alias("mention_count"),
        _percentage(count, total).alias("feedback_percentage"),
        round_half_even(F.avg("rating"), 3).alias("average_rating"),
        round_half_even(F.avg("confidence"), 3).alias("confidence"),
        _closed_map("sentiment", fixed.SENTIMENTS).alias("sentiment_distribution"),
        _closed_map("severity", (*fixed.SEVERITIES, "unknown")).alias("severity_distribution"),
        F.struct(_day(F.min("day")).alias("start"), _day(F.max("day")).alias("end")).alias("date_range"),
        known.alias("_known_sources"),
    )
    joined = core.join(representative_quotes(mentions), "theme_name", "left")
    quotes = F.coalesce("evidence_quotes", F.array().cast(f"array<{QUOTE_TYPE}>"))
    with_quotes = joined.withColumns(
        {"evidence_quotes": quotes, "representative_quotes": F.transform(quotes, lambda q: q["quote"])}
    )
    n_quotes = F.size("evidence_quotes")
    warned = with_quotes.withColumn("warnings", theme_warnings(F.col("mention_count"), n_quotes))
    strength = evidence_strength(
        F.col("mention_count"), n_quotes, F.col("confidence"), F.col("_known_sources"), F.size("warnings")
    )
    return warned.select(
        "theme_name", "primary_count", "secondary_count", "mention_count", "feedback_percentage", "average_rating",
        "sentiment_distribution", "severity_distribution",
        "date_range",
        "representative_quotes", "evidence_quotes",
        root_causes(F.col("theme_name"), F.col("mention_count")).alias("possible_root_causes"),
        suggested_actions(F.col("theme_name"), preset).alias("suggested_product_actions"),
        strength.alias("evidence_strength"),
        "confidence",
        F.lit("pending").alias("human_review_status"),
        "warnings",
    ).orderBy(F.desc("mention_count"), "theme_name")


def aggregate_themes(
    analysis: DataFrame, fb: DataFrame, materialize: bool = True, action_preset: str = DEFAULT_PRESET
) -> Aggregation:
    """Insights with their complete supporting tables.

    The narrow mention table feeds every aggregate, so by default it is
    written once to the shared folder instead of being recomputed.
    """
    mentions = mention_table(analysis, fb)
    if materialize:
        mentions = stage(mentions, "mentions")
    total = total_records(fb)
    orphans = orphan_ids(analysis, fb)
    warnings = orphans.select("message")
    if total == 0 and fb.isEmpty():
        warnings = warnings.sparkSession.createDataFrame([(fixed.MSG_AGGREGATE_EMPTY,)], "message string")
    counts = distributions(mentions, "user_type" in fb.columns)
    return Aggregation(build_insights(mentions, total, action_preset), mentions, counts, orphans, total, warnings.orderBy("message"))


# --- ranking ----------------------------------------------------------------


def avg_known_severity(severities: Column) -> Column:
    """Mean severity score over the known labels of a count map; 0 without any."""
    counts = {s: F.coalesce(F.try_element_at(severities, F.lit(s)), F.lit(0)) for s in fixed.SEVERITIES}
    score = reduce(lambda a, b: a + b, [n * float(fixed.SEVERITY_SCORES[s]) for s, n in counts.items()])
    records = reduce(lambda a, b: a + b, counts.values())
    return F.when(records > 0, score / records).otherwise(0.0)


def theme_priority(insights: DataFrame, total: int) -> DataFrame:
    """Adds frequency, severity and confidence components and their product."""
    usable = (F.lit(total) > 0) & (F.col("mention_count") > 0)
    frequency = F.col("mention_count") / F.lit(float(max(total, 1)))
    severity = avg_known_severity(F.col("severity_distribution")) / 5.0

    def part(value: Column) -> Column:
        return F.when(usable, round_half_even(value, 4)).otherwise(0.0)

    score = part(frequency * severity * F.col("confidence"))
    return insights.withColumns(
        {
            "priority_score": score,
            "priority_components": F.struct(
                score.alias("priority_score"),
                part(frequency).alias("frequency_score"),
                part(severity).alias("severity_score"),
                part(F.col("confidence")).alias("confidence_score"),
                F.lit(fixed.PRIORITY_METHOD).alias("priority_method"),
                F.lit(fixed.PRIORITY_WARNING).alias("priority_warning"),
            ),
        }
    )


def prioritize(insights: DataFrame, total: int) -> DataFrame:
    """Insights with priority, highest first."""
    return theme_priority(insights, total).orderBy(F.desc("priority_score"), F.desc("mention_count"), "theme_name")


