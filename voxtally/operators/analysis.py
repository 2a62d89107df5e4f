"""Per-record analysis of masked feedback."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxtally import fixed
from voxtally.functions import topics
from voxtally.functions.exprs import keep, normalize_text, round_half_even, settle, strings
from voxtally.functions.skew import key_counts
from voxtally.operators.similarity import TfidfModel, tfidf_fallback, tfidf_fit
from voxtally.sources.taxonomy import DEFAULT_PRESET, load_rules

ANALYSIS_COLUMNS = (
    "feedback_id", "sentiment", "sentiment_score", "primary_theme", "primary_subtheme", "primary_confidence",
    "secondary_themes", "product_area", "severity", "severity_score", "intent", "customer_problem", "confidence",
    "matched_terms", "supporting_feedback_ids", "requires_human_review", "analysis_method", "analysis_warnings",
    "cluster_id", "theme",
)


def check_input(df: DataFrame, column: str = "masked_text") -> None:
    if "feedback_id" not in df.columns:
        raise KeyError("There is no feedback_id to analyse by.")
    if column not in df.columns:
        if column == "masked_text" and "feedback_text" in df.columns:
            raise KeyError(fixed.MSG_NEEDS_MASKED_ANALYSIS)
        raise KeyError(f"There is no column '{column}' to analyse.")


def with_hits(df: DataFrame, rules: Sequence[dict], column: str = "masked_text") -> DataFrame:
    """Adds the normalised text and the list of known terms in it."""
    text = normalize_text(F.col(column))
    return settle(df, _text=text, _hits=topics.term_hits(F.lower(text), rules))


def sentiment(df: DataFrame, rules: Sequence[dict] | None = None, column: str = "masked_text") -> DataFrame:
    """Adds the ``sentiment_result`` struct."""
    hits = with_hits(df, rules or [], column)
    return hits.withColumn("sentiment_result", topics.sentiment(F.col("_text"), F.col("_hits"))).drop("_text", "_hits")


def with_keyword_themes(df: DataFrame, rules: Sequence[dict], column: str = "masked_text") -> DataFrame:
    """Adds ``_themes`` (keyword classification); row-local, so it also runs on a stream."""
    hits = with_hits(df, rules, column)
    ranked = topics.rank_themes(topics.theme_scores(F.col("_hits"), rules), F.col("_hits"), rules)
    return settle(hits, _themes=topics.classify_theme(F.col("_text"), ranked))


def classify_theme(df: DataFrame, rules: Sequence[dict], column: str = "masked_text") -> DataFrame:
    """Adds the keyword classification as ``theme_result``."""
    return with_keyword_themes(df, rules, column).withColumnRenamed("_themes", "theme_result").drop("_text", "_hits")


def needs_fallback() -> Column:
    weak = F.col("_themes.primary_confidence") < fixed.PRIMARY_MIN_CONFIDENCE
    return F.col("_text").isNotNull() & ((F.col("_themes.primary_theme") == "unknown") | weak)


def _with_fallback(df: DataFrame, rules: Sequence[dict], model: TfidfModel | None) -> DataFrame:
    merged = tfidf_fallback(df, model, rules, F.col("_text"), F.col("_hits"), needs_fallback())
    other, own = F.col("_fallback"), F.col("_themes")
    used = other.isNotNull()
    return merged.withColumn(
        "_themes",
        F.struct(
            F.when(used, other["theme"]).otherwise(own["primary_theme"]).alias("primary_theme"),
            F.when(used, other["subtheme"]).otherwise(own["primary_subtheme"]).alias("primary_subtheme"),
            F.when(used, other["confidence"]).otherwise(own["primary_confidence"]).alias("primary_confidence"),
            own["secondary_themes"].alias("secondary_themes"),
            F.when(used, strings(["tfidf_similarity"])).otherwise(own["matched_terms"]).alias("matched_terms"),
            F.when(used, other["product_area"]).otherwise(own["product_area"]).alias("product_area"),
            F.when(used, other["severity"]).otherwise(own["severity"]).alias("severity"),
            F.when(used, "tfidf_fallback").otherwise(own["method"]).alias("method"),
            F.when(used, fixed.MSG_FALLBACK).otherwise(own["warning"]).alias("warning"),
            (used | own["requires_human_review"]).alias("requires_human_review"),
        ),
    ).drop("_fallback")


def classify_themes_batch(
    df: DataFrame, rules: Sequence[dict], column: str = "masked_text", model: TfidfModel | None = None
) -> DataFrame:
    """Keyword classification with the similarity fallback for weak rows, as ``theme_result``."""
    model = model or tfidf_fit(df, column)
    themed = _with_fallback(with_keyword_themes(df, rules, column), rules, model)
    return themed.withColumnRenamed("_themes", "theme_result").drop("_text", "_hits")


def combine_confidence(theme_confidence: Column, sentiment_score: Column) -> Column:
    return round_half_even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), theme_confidence * 0.75 + sentiment_score * 0.25)), 3)


def requires_human_review(themes: Column, pii_review: Column, confidence: Column, sentiment_label: Column) -> Column:
    return (
        themes["requires_human_review"]
        | F.coalesce(pii_review, F.lit(False))
        | (themes["primary_theme"] == "unknown")
        | (confidence < fixed.REVIEW_BELOW_CONFIDENCE)
        | (sentiment_label == "unknown")
    )


def _records(df: DataFrame, themed: DataFrame, rules: Sequence[dict]) -> DataFrame:
    pii = F.coalesce(F.col("pii_review_required"), F.lit(False)) if "pii_review_required" in df.columns else F.lit(False)
    cluster = F.col("cluster_id") if "cluster_id" in df.columns else F.lit(None).cast("int")
    order = [F.col("_row_number")] if "_row_number" in df.columns else []
    text, themes, tone = F.col("_text"), F.col("_themes"), F.col("_tone")
    missing = text.isNull()
    staged = themed.withColumn("_tone", topics.sentiment(text, F.col("_hits"))).withColumn(
        "_confidence", combine_confidence(themes["primary_confidence"], F.col("_tone.score"))
    )
    default_intent = topics.rule_value(themes["primary_theme"], rules, "default_intent")
    named_intent = topics.intent(F.lower(text), F.col("_hits"), default_intent)
    warnings = keep(
        F.when(missing, fixed.MSG_MASKED_MISSING),
        F.when(~missing & (themes["primary_theme"] == "unknown"), fixed.MSG_NO_THEME),
        F.when(~missing, themes["warning"]),
        F.when(pii, fixed.MSG_PII_REVIEW),
    )
    return staged.select(
        F.col("feedback_id").cast("string").alias("feedback_id"),
        tone["label"].alias("sentiment"),
        tone["score"].alias("sentiment_score"),
        themes["primary_theme"].alias("primary_theme"),
        themes["primary_subtheme"].alias("primary_subtheme"),
        themes["primary_confidence"].alias("primary_confidence"),
        themes["secondary_themes"].alias("secondary_themes"),
        themes["product_area"].alias("product_area"),
        themes["severity"].alias("severity"),
        topics.severity_score(themes["severity"]).alias("severity_score"),
        F.when(missing | (themes["primary_theme"] == "unknown"), "unknown").otherwise(named_intent).alias("intent"),
        topics.customer_problem(themes["primary_theme"], themes["matched_terms"]).alias("customer_problem"),
        F.col("_confidence").alias("confidence"),
        themes["matched_terms"].alias("matched_terms"),
        F.array(F.col("feedback_id").cast("string")).alias("supporting_feedback_ids"),
        requires_human_review(themes, pii, F.col("_confidence"), tone["label"]).alias("requires_human_review"),
        themes["method"].alias("analysis_method"),
        warnings.alias("analysis_warnings"),
        cluster.alias("cluster_id"),
        themes["primary_theme"].alias("theme"),
        *order,
    )


def analyze_rows(df: DataFrame, preset: str = DEFAULT_PRESET, column: str = "masked_text") -> DataFrame:
    """The row-local part: everything but the similarity fallback and clusters.  Works on streams."""
    check_input(df, column)
    rules = load_rules(preset)
    return _records(df, with_keyword_themes(df, rules, column), rules)


def analyze_feedback(
    df: DataFrame, preset: str = DEFAULT_PRESET, column: str = "masked_text", model: TfidfModel | None = None
) -> DataFrame:
    """One row per record with the full result.

    ``cluster_id`` is taken from the input where it has one (see
    ``cluster_feedback``).  ``_row_number`` is carried along when present: it
    orders repeated ids.
    """
    check_input(df, column)
    rules = load_rules(preset)
    model = model or tfidf_fit(df, column)
    return _records(df, _with_fallback(with_keyword_themes(df, rules, column), rules, model), rules)


def analysis_totals(analysis: DataFrame) -> DataFrame:
    known = F.col("primary_theme") != "unknown"
    return analysis.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(known).alias("analyzed_records"),
        F.count_if(~known).alias("unknown_records"),
        F.count_if("requires_human_review").alias("human_review_records"),
    )


def analysis_warnings(analysis: DataFrame, cluster_warnings: Sequence[str] = ()) -> list[str]:
    """Batch warnings: empty input, what clustering reported, repeated ids."""
    if analysis.isEmpty():
        return [fixed.MSG_ANALYSIS_EMPTY]
    repeated = not key_counts(analysis, "feedback_id").where("key_rows > 1").isEmpty()
    return [*cluster_warnings, *([fixed.MSG_ANALYSIS_DUPLICATES] if repeated else [])]
