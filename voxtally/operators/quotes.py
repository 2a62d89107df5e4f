"""Representative quotes and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally import fixed
from voxtally.functions.exprs import normalize_text, strip, trim_to_null
from voxtally.functions.skew import lookup_join, newest
from voxtally.operators.mentions import row_order

QUOTE_TYPE = (
    "struct<feedback_id:string,quote:string,source:string,date:string,rating:double,"
    "quote_is_exact:boolean,validation_status:string,validation_message:string>"
)


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """First k rows per key by rank.  Spark applies the limit before the shuffle as well."""
    order = Window.partitionBy(*keys).orderBy("rank")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def representative_quotes(mentions: DataFrame, k: int = fixed.MAX_QUOTES) -> DataFrame:
    """Up to k quotes per theme, best confidence first, each from another source and with another text.

    The greedy choice only ever sees a bounded, exactly sufficient candidate
    list.  With k picks, a pick takes at most one source and one text away from
    the rest, so per source the k best distinct texts suffice, then per text
    the k best sources, and then per theme the first (k-1)(2k-1)+1 rows.
    """
    rank = F.struct((-F.col("record_confidence")).alias("c"), F.col("feedback_id").alias("id"))
    candidates = mentions.where("quote is not null").select(
        "theme_name", F.coalesce("source", F.lit("unknown")).alias("pool"), "quote", rank.alias("rank"), "source", "date", "rating"
    )
    row = F.struct("rank", "source", "date", "rating")
    distinct = candidates.groupBy("theme_name", "pool", "quote").agg(F.min(row).alias("r")).select(
        "theme_name", "pool", "quote", "r.*"
    )
    per_source = _top(distinct, ["theme_name", "pool"], k)
    per_text = _top(per_source, ["theme_name", "quote"], k)
    short_list = _top(per_text, ["theme_name"], (k - 1) * (2 * k - 1) + 1)
    listed = F.array_sort(F.collect_list(F.struct("rank", "pool", "quote", "source", "date", "rating")))

    def take(chosen: Column, c: Column) -> Column:
        clash = F.exists(chosen, lambda x: (x["pool"] == c["pool"]) | (x["quote"] == c["quote"]))
        return F.when((F.size(chosen) >= k) | clash, chosen).otherwise(F.array_append(chosen, c))

    def as_quote(c: Column) -> Column:
        return F.struct(
            c["rank"]["id"].alias("feedback_id"), c["quote"].alias("quote"), c["source"].alias("source"),
            c["date"].alias("date"), c["rating"].alias("rating"), F.lit(True).alias("quote_is_exact"),
            F.lit("valid").alias("validation_status"), F.lit(fixed.MSG_QUOTE_VALID).alias("validation_message"),
        ).cast(QUOTE_TYPE)

    grouped = short_list.groupBy("theme_name").agg(listed.alias("c"))
    picked = F.aggregate("c", F.slice("c", 1, 0), take)
    return grouped.select("theme_name", F.transform(picked, as_quote).alias("evidence_quotes"))


def quote_rows(quotes: DataFrame) -> DataFrame:
    """Long form of ``evidence_quotes``, one row per quote with its position."""
    return quotes.select("theme_name", F.posexplode("evidence_quotes").alias("position", "q")).select(
        "theme_name", "position", "q.*"
    )


def validate_quotes(
    quotes: DataFrame, fb: DataFrame, analysis: DataFrame | None = None, few: bool = False
) -> DataFrame:
    """Check (theme_name, feedback_id, quote) rows against the masked texts and, if given, the analyses.

    The last feedback row and the last analysis of an id count.  ``few`` says
    that the quotes are those of an insight table, a handful per theme: then
    only the rows they name are looked at, and few texts are shuffled.
    """
    def optional(name: str, kind: str = "string") -> Column:
        column = F.col(name).cast("string") if name in fb.columns else F.lit(None).cast("string")
        return trim_to_null(column) if kind == "string" else column.try_cast(kind)

    facts = fb.select(
        trim_to_null(F.col("feedback_id").cast("string")).alias("_id"),
        normalize_text(F.col("masked_text")).alias("_text"),
        optional("source").alias("_source"), optional("date").alias("_date"), optional("rating", "double").alias("_rating"),
        row_order(fb).alias("_order"),
    ).where("_id is not null")
    own = ["theme_name", "feedback_id", "quote"]
    asked = quotes.withColumns({"_id": trim_to_null(F.col("feedback_id")), "_quote": strip(F.coalesce("quote", F.lit("")))})
    named_ids = asked.select("_id").distinct() if few else None  # broadcast by Spark if small
    if few:
        facts = facts.join(named_ids, "_id", "left_semi")
    latest = newest(facts, "_id", F.struct("_order", F.xxhash64("_text", "_source", "_date").alias("t")),
                    "_text", "_source", "_date", "_rating").withColumn("_found", F.lit(True))
    joined = lookup_join(asked, latest, "_id")
    supports = F.lit(True)
    if analysis is not None:
        named = F.concat(F.array("primary_theme"), F.transform("secondary_themes", lambda s: s["theme"]))
        claims = analysis.select(F.col("feedback_id").alias("_id"), named.alias("_named"), row_order(analysis).alias("_order"))
        if few:
            claims = claims.join(named_ids, "_id", "left_semi")
        joined = lookup_join(joined, newest(claims, "_id", F.struct("_order", "_named"), "_named"), "_id")
        no_theme = F.coalesce(F.col("theme_name"), F.lit("")) == ""
        supports = no_theme | F.coalesce(F.array_contains("_named", F.col("theme_name")), F.lit(False))
    exact = F.col("_quote") == F.col("_text")
    within = F.contains(F.col("_text"), F.col("_quote"))
    cases = [
        (F.col("_id").isNull(), "missing_feedback_id", fixed.MSG_QUOTE_NO_ID),
        (F.col("_found").isNull(), "missing_source", fixed.MSG_QUOTE_NO_SOURCE),
        (F.col("_text").isNull(), "invalid", fixed.MSG_QUOTE_NO_TEXT),
        (F.col("_quote") == "", "invalid", fixed.MSG_QUOTE_EMPTY),
        (~within, "invalid", fixed.MSG_QUOTE_NOT_EXCERPT),
        (~supports, "invalid", fixed.MSG_QUOTE_NOT_SUPPORTING),
    ]
    status = message = F
    for test, label, text in cases:
        status, message = status.when(test, label), message.when(test, text)
    checked = joined.withColumns(
        {"validation_status": status.otherwise("valid"), "validation_message": message.otherwise(fixed.MSG_QUOTE_VALID)}
    )
    located = F.col("validation_message").isin(
        fixed.MSG_QUOTE_NOT_EXCERPT, fixed.MSG_QUOTE_NOT_SUPPORTING, fixed.MSG_QUOTE_VALID
    )
    extra = [c for c in quotes.columns if c not in own]
    return checked.select(
        "theme_name", F.coalesce("_id", "feedback_id", F.lit("")).alias("feedback_id"),
        F.when(located, F.col("_quote")).otherwise(F.col("quote")).alias("quote"),
        F.when(located, F.col("_source")).alias("source"), F.when(located, F.col("_date")).alias("date"),
        F.when(located, F.col("_rating")).alias("rating"),
        ((F.col("validation_status") == "valid") & exact).alias("quote_is_exact"),
        "validation_status", "validation_message", *extra,
    )


def revalidate_insights(insights: DataFrame, fb: DataFrame, analysis: DataFrame | None = None) -> DataFrame:
    """Check the quotes of each insight again; refresh quotes, warnings and strength.

    An insight without evidence quotes has its representative quotes checked
    instead; without an id they cannot be valid.  Quotes per insight are few.
    """
    from_texts = F.transform("representative_quotes", lambda q: F.struct(F.lit("").alias("feedback_id"), q.alias("quote")))
    from_evidence = F.transform("evidence_quotes", lambda q: F.struct(q["feedback_id"].alias("feedback_id"), q["quote"].alias("quote")))
    to_check = F.when(F.size("evidence_quotes") > 0, from_evidence).otherwise(from_texts)
    rows = insights.select("theme_name", F.posexplode(to_check).alias("position", "q")).select("theme_name", "position", "q.*")
    checked = validate_quotes(rows, fb, analysis, few=True)
    valid = F.col("validation_status") == "valid"
    quote = F.struct("feedback_id", "quote", "source", "date", "rating", "quote_is_exact", "validation_status", "validation_message")
    first = checked.groupBy("theme_name", "feedback_id", "quote", valid.alias("_ok")).agg(
        F.min(F.struct("position", quote.cast(QUOTE_TYPE).alias("q"), "validation_message")).alias("r")
    )
    again = first.groupBy("theme_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("r.position", "r.q")))).alias("_good"),
        F.array_compact(F.collect_set(F.when(~F.col("_ok"), F.col("r.validation_message")))).alias("_problems"),
    )
    good = F.transform("_good", lambda g: g["q"])
    joined = insights.join(again, "theme_name", "left")
    weak = (F.size("_problems") > 0) & (F.size("_good") == 0)
    no_quotes = F.array().cast(f"array<{QUOTE_TYPE}>")
    return joined.withColumns(
        {
            "evidence_quotes": F.coalesce(good, no_quotes),
            "representative_quotes": F.coalesce(F.transform(good, lambda q: q["quote"]), F.array().cast("array<string>")),
            "warnings": F.array_sort(F.array_distinct(F.concat("warnings", F.coalesce("_problems", F.array().cast("array<string>"))))),
            "evidence_strength": F.when(weak, "weak").otherwise(F.col("evidence_strength")),
        }
    ).drop("_good", "_problems")
