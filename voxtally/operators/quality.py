"""Row validation, duplicate detection and data-quality reports."""

from __future__ import annotations

from functools import reduce
from typing import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from voxtally import fixed
from voxtally.functions.exprs import keep, settle, strings, trim_to_null
from voxtally.functions.skew import key_counts, lookup_join
from voxtally.functions.values import date_error, parse_date, parse_rating, rating_error

CLEAN_COLUMNS = ("_row_number", "row_status", "validation_errors", "date_normalized", *fixed.FEEDBACK_COLUMNS)
ISSUE_TYPES = (
    "empty_feedback_id", "empty_feedback_text", "invalid_rating", "invalid_date",
    "duplicate_feedback_id", "duplicate_feedback_text",
)


def with_feedback_columns(df: DataFrame) -> DataFrame:
    """All nine feedback columns as strings (missing ones null), other columns kept."""
    wanted = [
        (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
        for c in fixed.FEEDBACK_COLUMNS
    ]
    number = F.col("_row_number").cast("long") if "_row_number" in df.columns else F.lit(None).cast("long")
    return df.select(number.alias("_row_number"), *wanted)


def _trimmed(df: DataFrame) -> DataFrame:
    texts = [c for c in fixed.FEEDBACK_COLUMNS if c not in ("rating", "date")]
    return with_feedback_columns(df).withColumns({c: trim_to_null(F.col(c)) for c in texts})


def _with_errors(trimmed: DataFrame) -> DataFrame:
    checked = settle(trimmed, _day=parse_date(F.col("date")))
    return checked.withColumns(
        {
            "_id_error": F.when(F.col("feedback_id").isNull(), fixed.MSG_EMPTY_ID),
            "_text_error": F.when(F.col("feedback_text").isNull(), fixed.MSG_EMPTY_TEXT),
            "_rating_error": rating_error(F.col("rating")),
            "_date_error": date_error(F.col("date"), F.col("_day")),
            "date_normalized": F.date_format("_day", "yyyy-MM-dd"),
            "rating": parse_rating(F.col("rating")),
            "date": trim_to_null(F.col("date")),
        }
    )


def check_rows(df: DataFrame) -> DataFrame:
    """Row-local part of cleaning: trimmed values, parsed rating and date, messages.

    Stateless, so it runs on a stream as well.
    """
    return _with_errors(_trimmed(df))


def _own_status() -> Column:
    bad = F.col("_id_error").isNotNull() | F.col("_text_error").isNotNull() | F.col("_rating_error").isNotNull()
    return F.when(bad, "error").when(F.col("_date_error").isNotNull(), "warning").otherwise("valid")


def row_status(df: DataFrame) -> DataFrame:
    """Cleaned rows with status and messages from their own values only (no duplicate checks)."""
    messages = F.array_join(keep(*[F.col(c) for c in ("_id_error", "_text_error", "_rating_error", "_date_error")]), "; ")
    checked = check_rows(df)
    return checked.withColumns({"row_status": _own_status(), "validation_errors": messages}).select(*CLEAN_COLUMNS)


def flag_repeats(df: DataFrame, key: str, flag: str, counted: DataFrame | None = None) -> DataFrame:
    """Boolean ``flag``: the non-null key occurs on more than one row.

    ``counted`` is a cheaper DataFrame with the same rows to count the keys in.
    """
    repeated = key_counts(df if counted is None else counted, key).where("key_rows > 1")
    hit = repeated.select(key, F.lit(True).alias(flag))
    joined = lookup_join(df, hit, key)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def text_key() -> Column:
    """Digest of the trimmed lower-case text, so no long text is shuffled as a key."""
    return F.sha2(F.lower(trim_to_null(F.col("feedback_text"))), 256)


def flag_duplicate_ids(df: DataFrame) -> DataFrame:
    return flag_repeats(df, "feedback_id", "duplicate_id")


def flag_duplicate_text(df: DataFrame) -> DataFrame:
    """Equal trimmed lower-case text, compared by a 256-bit digest."""
    return flag_repeats(df.withColumn("_text_key", text_key()), "_text_key", "duplicate_text").drop("_text_key")


def checked_rows(df: DataFrame) -> DataFrame:
    """Every row with its messages, both duplicate flags, status and joined messages."""
    own = _own_status()
    rows = _trimmed(df).withColumn("_text_key", text_key())
    with_ids = flag_repeats(rows, "feedback_id", "duplicate_id")
    flagged = flag_repeats(with_ids, "_text_key", "duplicate_text", counted=rows).drop("_text_key")
    # Order of effects: repeated text only touches rows still valid, then a
    # repeated id turns every row that is not yet an error into one.
    text_hit = F.col("duplicate_text") & (own == "valid")
    id_hit = F.col("duplicate_id") & (own != "error")
    status = F.when(id_hit, "error").when(text_hit, "warning").otherwise(own)
    messages = keep(
        F.col("_id_error"), F.col("_text_error"), F.col("_rating_error"), F.col("_date_error"),
        F.when(text_hit, fixed.MSG_DUP_TEXT), F.when(id_hit, fixed.MSG_DUP_ID),
    )
    return _with_errors(flagged).withColumns({"row_status": status, "validation_errors": F.array_join(messages, "; ")})


def clean_feedback(df: DataFrame) -> DataFrame:
    """All rows, cleaned, with status; nothing is dropped."""
    return checked_rows(df).select(*CLEAN_COLUMNS)


def valid_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("row_status") != "error")


def row_issues(checked: DataFrame) -> DataFrame:
    """One row per issue from ``checked_rows`` output."""

    def issue(kind: str, test: Column, message: Column, level: str) -> Column:
        return F.when(
            test, F.struct(F.lit(kind).alias("issue_type"), message.alias("message"), F.lit(level).alias("severity"))
        )

    dup_id = F.concat(F.lit("Duplicate feedback_id '"), F.col("feedback_id"), F.lit("' detected."))
    issues = keep(
        *[
            issue(kind, F.col(c).isNotNull(), F.col(c), level)
            for kind, c, level in (
                ("empty_feedback_id", "_id_error", "error"),
                ("empty_feedback_text", "_text_error", "error"),
                ("invalid_rating", "_rating_error", "error"),
                ("invalid_date", "_date_error", "warning"),
            )
        ],
        issue("duplicate_feedback_id", F.col("duplicate_id"), dup_id, "error"),
        issue("duplicate_feedback_text", F.col("duplicate_text"), F.lit(fixed.MSG_DUP_TEXT), "warning"),
    )
    return checked.select(F.col("_row_number").alias("row_number"), "feedback_id", F.explode(issues).alias("i")).select(
        "row_number", "feedback_id", "i.issue_type", "i.message", "i.severity"
    )


def quality_report(
    checked: DataFrame,
    mapping: Mapping[str, str] | None = None,
    detected_columns: list[str] | None = None,
    encoding: str = "utf-8",
    size_bytes: int = 0,
    source_name: str = "",
) -> DataFrame:
    """One row of counts and schema facts; a single aggregate over ``checked_rows`` output.

    The distinct messages quote ids and values, so their number grows with the
    data: they are a table of their own, see ``quality_messages``.
    """
    mapping = dict(mapping) if mapping is not None else {c: c for c in fixed.FEEDBACK_COLUMNS}
    mapped = set(mapping.values())
    total = F.count(F.lit(1))
    bad = F.count_if(F.col("row_status") == "error")
    counts = checked.agg(
        total.alias("total_rows"),
        (total - bad).alias("valid_rows"),
        bad.alias("invalid_rows"),
        F.count_if(F.col("_text_error").isNotNull()).alias("empty_feedback_rows"),
        F.count_if("duplicate_id").alias("duplicate_id_rows"),
        F.count_if("duplicate_text").alias("duplicate_text_rows"),
        F.count_if(F.col("_rating_error").isNotNull()).alias("invalid_rating_rows"),
        F.count_if(F.col("_date_error").isNotNull()).alias("invalid_date_rows"),
    )
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return counts.select(
        "*",
        strings([c for c in fixed.REQUIRED_COLUMNS if c not in mapped]).alias("missing_required_columns"),
        strings([c for c in fixed.OPTIONAL_COLUMNS if c not in mapped]).alias("missing_optional_columns"),
        F.lit(encoding).alias("detected_encoding"),
        F.lit(size_bytes).cast("long").alias("file_size_bytes"),
        F.lit(source_name).alias("source_name"),
        strings(detected_columns if detected_columns is not None else list(mapping)).alias("detected_columns"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("mapped_columns"),
    )


def quality_messages(issues: DataFrame) -> DataFrame:
    """Distinct warning and error messages, sorted, with the number of rows behind each."""
    return issues.groupBy("severity", "message").agg(F.count(F.lit(1)).alias("rows")).orderBy("severity", "message")


# --- conformance ------------------------------------------------------------


def _member(column: str, allowed) -> Column:
    return F.coalesce(F.lower(trim_to_null(F.col(column))).isin(*allowed), F.lit(False))


def _filled(column: str) -> Column:
    return trim_to_null(F.col(column)).isNotNull()


def _within(column: str, low: float | None, high: float | None, optional: bool = False) -> Column:
    value = F.col(column)
    test = F.lit(True)
    if low is not None:
        test = test & (value >= low)
    if high is not None:
        test = test & (value <= high)
    return F.coalesce(test, F.lit(optional))


def constraints(kind: str) -> dict[str, Column]:
    """Named row constraints per table kind; true means the row conforms."""
    if kind == "feedback":
        return {
            "feedback_id_filled": _filled("feedback_id"),
            "feedback_text_filled": _filled("feedback_text"),
            "rating_in_range": _within("rating", fixed.MIN_RATING, fixed.MAX_RATING, optional=True),
        }
    if kind == "evaluation":
        return {
            **{f"{c}_filled": _filled(c) for c in ("feedback_id", "feedback_text", "expected_theme", "expected_product_area")},
            "expected_sentiment_known": _member("expected_sentiment", fixed.SENTIMENTS),
            "expected_severity_known": _member("expected_severity", fixed.SEVERITIES),
        }
    if kind == "analysis":
        return {
            "feedback_id_filled": _filled("feedback_id"),
            "sentiment_known": _member("sentiment", fixed.SENTIMENTS),
            "severity_known": _member("severity", (*fixed.SEVERITIES, "unknown")),
            "intent_known": _member("intent", fixed.INTENTS),
            "analysis_method_known": _member("analysis_method", fixed.ANALYSIS_METHODS),
            "sentiment_score_0_1": _within("sentiment_score", 0.0, 1.0),
            "primary_confidence_0_1": _within("primary_confidence", 0.0, 1.0),
            "confidence_0_1": _within("confidence", 0.0, 1.0),
            "severity_score_1_5": _within("severity_score", 1.0, 5.0),
        }
    if kind == "pii":
        return {
            "span_order": ~F.exists("entities", lambda e: e["end"] < e["start"]),
            "span_length": ~F.exists("entities", lambda e: (e["end"] - e["start"]) != e["original_length"]),
            "masked_value_filled": ~F.exists("entities", lambda e: F.length(e["masked_value"]) == 0),
        }
    if kind == "insight":
        return {
            "theme_name_filled": _filled("theme_name"),
            "mention_count_not_negative": _within("mention_count", 0, None),
            "mentions_add_up": F.col("mention_count") == F.col("primary_count") + F.col("secondary_count"),
            "feedback_percentage_0_100": _within("feedback_percentage", 0.0, 100.0),
            "confidence_0_1": _within("confidence", 0.0, 1.0),
            "evidence_strength_known": _member("evidence_strength", fixed.EVIDENCE_STRENGTHS),
            "human_review_status_known": _member("human_review_status", fixed.REVIEW_STATUSES),
        }
    if kind == "decision":
        return {"theme_name_filled": _filled("theme_name"), "status_known": _member("status", fixed.REVIEW_STATUSES)}
    raise ValueError(f"Unknown table kind '{kind}'.")


def conformance_report(df: DataFrame, kind: str) -> DataFrame:
    """Rows checked and rows violating, per constraint; one aggregate over the table."""
    tests = constraints(kind)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.col(n).alias("violations")) for n in tests])
    return counts.select(F.col("_rows").alias("rows_checked"), F.explode(rows).alias("r")).select(
        "r.constraint_name", "rows_checked", "r.violations"
    )


def violating_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows that break any constraint, with the names of those broken."""
    tests = constraints(kind)
    broken = keep(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()])
    any_broken = reduce(lambda a, b: a | b, [~F.coalesce(t, F.lit(False)) for t in tests.values()])
    return df.where(any_broken).withColumn("violated", broken)
