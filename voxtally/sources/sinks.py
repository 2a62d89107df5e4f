"""Privacy-checked outputs: CSV, JSON and Markdown."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import reduce
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxtally import fixed
from voxtally.functions.pii import any_unmasked, unmasked
from voxtally.functions.exprs import round_half_even
from voxtally.operators.decisions import apply_decisions
from voxtally.operators.explore import join_first_feedback, secondary_names
from voxtally.operators.present import theme_label, valid_quote_count
from voxtally.session import stage


class ExportPrivacyError(ValueError):
    """An output would reveal raw text or personal data."""


# --- privacy gate -----------------------------------------------------------


def _field_names(kind: T.DataType) -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield f.name
            yield from _field_names(f.dataType)
    elif isinstance(kind, T.ArrayType):
        yield from _field_names(kind.elementType)
    elif isinstance(kind, T.MapType):
        yield from _field_names(kind.keyType)
        yield from _field_names(kind.valueType)


def _any(column: Column, kind: T.DataType, strings: Callable[[Column], Column], maps: Callable[[Column], Column]) -> Column | None:
    """Whether a test holds anywhere below ``column``: ``strings`` for a string, ``maps`` for a map with string keys; null if nothing is tested."""
    found = []
    if isinstance(kind, T.StringType):
        found.append(strings(column))
    elif isinstance(kind, T.StructType):
        found += [_any(column[f.name], f.dataType, strings, maps) for f in kind.fields]
    elif isinstance(kind, T.ArrayType):
        if _any(F.lit(None), kind.elementType, strings, maps) is not None:
            found.append(F.exists(column, lambda x: _any(x, kind.elementType, strings, maps)))
    elif isinstance(kind, T.MapType):
        if isinstance(kind.keyType, T.StringType):
            found.append(maps(column))
        found += [_any(part(column), T.ArrayType(of), strings, maps) for part, of in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))]
    tests = [F.coalesce(t, F.lit(False)) for t in found if t is not None]
    return reduce(lambda a, b: a | b, tests) if tests else None


def _row_test(df: DataFrame, strings: Callable[[Column], Column], maps: Callable[[Column], Column] = lambda m: F.lit(False)) -> Column:
    tests = [_any(F.col(f"`{f.name}`"), f.dataType, strings, maps) for f in df.schema.fields]
    return reduce(lambda a, b: a | b, [t for t in tests if t is not None], F.lit(False))


def row_reveals(df: DataFrame, entity_type: str | None = None) -> Column:
    """True where any string of the row, nested or not, map keys included, holds readable personal data (of one type)."""
    return _row_test(df, any_unmasked if entity_type is None else lambda c: unmasked(c, entity_type))


def row_has_raw_key(df: DataFrame) -> Column:
    """True where a map of the row has the name of a raw-text column as a key."""
    named = lambda m: F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(n) for n in fixed.FORBIDDEN_EXPORT_COLUMNS]))
    return _row_test(df, lambda c: F.lit(False), named)


def forbidden_columns(df: DataFrame) -> list[str]:
    return [n for n in _field_names(df.schema) if n in fixed.FORBIDDEN_EXPORT_COLUMNS]


def privacy_findings(df: DataFrame) -> DataFrame:
    """Rows holding readable personal data, per type; one aggregate over all string leaves, one pattern for each type."""
    counts = [F.count_if(row_reveals(df, t)).alias(t) for t in fixed.GATE_TYPES]
    pairs = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("rows")) for t in fixed.GATE_TYPES])
    return df.agg(*counts).select(F.explode(pairs).alias("p")).select("p.entity_type", "p.rows")


def privacy_gate(df: DataFrame) -> DataFrame:
    """Raise if the table has a raw-text column or key, or any readable personal data; else return it."""
    _reject_columns(df)
    if not df.where(row_has_raw_key(df)).isEmpty():
        raise ExportPrivacyError("Nothing was written: a map has the name of a raw-text column as a key.")
    for row in privacy_findings(df).where("rows > 0").orderBy("entity_type").collect():
        raise ExportPrivacyError(f"Nothing was written: {row.rows} row(s) hold readable personal data of type {row.entity_type}.")
    return df


def _reject_columns(df: DataFrame) -> None:
    for name in forbidden_columns(df):
        raise ExportPrivacyError(f"Nothing was written: '{name}' is a raw-text column.")


def guarded(df: DataFrame) -> DataFrame:
    """The gate as part of the write itself: the job fails, and commits nothing, at the first bad row, and names the type.

    Saves the extra pass ``privacy_gate`` needs; meant for large outputs.
    """
    _reject_columns(df)
    first = df.columns[0]
    kind = df.schema[first].dataType
    refused = F
    for t in fixed.GATE_TYPES:
        refused = refused.when(row_reveals(df, t), F.lit(f"Nothing was written: a row holds readable personal data of type {t}."))
    refused = refused.when(row_has_raw_key(df), F.lit("Nothing was written: a map has the name of a raw-text column as a key."))
    # One cheap test for all types decides whether the types are told apart.
    bad = row_reveals(df) | row_has_raw_key(df)
    return df.withColumn(first, F.when(bad, F.raise_error(refused).cast(kind)).otherwise(F.col(f"`{first}`")))


# --- several tables as one output ---


MANIFEST = "_published.json"


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write, check, then show: all tables go to a hidden folder beside ``path``, a manifest of them follows, and one rename makes the folder
    visible.  If any write fails, the hidden folder goes and nothing is seen; a crash leaves a hidden folder that nobody reads.

    Where a store has no atomic rename, ``published`` tells by the manifest, which comes last, whether all is there.
    """
    spark = next(iter(tables.values())).sparkSession
    target, files = _folder(spark, path)
    if files.exists(target) and len(files.listStatus(target)):
        raise FileExistsError(f"{path} holds files already.")
    draft = f"{target.getParent().toString()}/.{target.getName()}-{uuid.uuid4().hex}"
    hidden, _ = _folder(spark, draft)
    try:
        for name, table in tables.items():
            write(table, f"{draft}/{name}")
        out = files.create(_folder(spark, f"{draft}/{MANIFEST}")[0], False)
        out.write(bytearray(json.dumps({"tables": list(tables)}).encode()))
        out.close()
        if files.exists(target):
            files.delete(target, False)  # an empty folder; one that has filled meanwhile is an error
        if not files.rename(hidden, target):
            raise OSError(f"{path} could not be published.")
    except BaseException:
        files.delete(hidden, True)
        raise


def published(spark: SparkSession, path: str) -> list[str]:
    """The tables of a complete output; none if there is no such output."""
    place, files = _folder(spark, f"{path}/{MANIFEST}")
    if not files.exists(place):
        return []
    stream = files.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
    finally:
        stream.close()


# --- records and insights ---------------------------------------------------


def export_records(analysis: DataFrame, fb: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The 19 export columns per analysed record, with the decision on its primary theme."""
    facts = ("masked_text", "source", "date", "rating", "pii_detected", "pii_entity_types")
    joined = join_first_feedback(analysis, fb, facts)
    types = F.col("fb_pii_entity_types")
    if dict(joined.dtypes)["fb_pii_entity_types"].startswith("array"):
        types = F.array_join(types, ", ")
    decided = apply_decisions(joined, decisions, "primary_theme")
    return decided.select(
        "feedback_id",
        F.when(F.col("_found"), F.col("fb_masked_text")).otherwise("").alias("masked_text"),
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
        F.coalesce(types, F.lit("")).alias("pii_entity_types"),
        "review_status",
        "reviewer_note",
    )


def export_insights(ranked: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The 16 export columns per theme, highest priority first."""
    part = F.col("priority_components")
    return apply_decisions(ranked, decisions).select(
        "theme_name",
        round_half_even(F.col("priority_score"), 4).alias("priority_score"),
        "mention_count",
        "primary_count",
        "secondary_count",
        round_half_even(F.col("feedback_percentage"), 1).alias("feedback_percentage"),
        round_half_even(F.col("average_rating"), 2).alias("average_rating"),
        "evidence_strength",
        round_half_even(F.col("confidence"), 3).alias("confidence"),
        "review_status",
        "reviewer_note",
        valid_quote_count().alias("valid_quotes_count"),
        F.col("mention_count").alias("supporting_ids_count"),
        part["frequency_score"].alias("frequency_score"),
        part["severity_score"].alias("severity_score"),
        part["confidence_score"].alias("confidence_score"),
    ).orderBy(F.desc("priority_score"), F.desc("mention_count"), "theme_name")


def write_csv(df: DataFrame, path: str) -> None:
    """Checked CSV with header.  The check is part of the write."""
    guarded(df).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def export_records_csv(analysis: DataFrame, fb: DataFrame, path: str, decisions: DataFrame | None = None) -> None:
    write_csv(export_records(analysis, fb, decisions), path)


def export_insights_csv(ranked: DataFrame, path: str, decisions: DataFrame | None = None) -> None:
    write_csv(export_insights(ranked, decisions), path)


def insight_documents(ranked: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One JSON object per theme.  Supporting ids are unbounded, so they are a table of their own."""
    part = F.col("priority_components")
    components = F.struct(*[part[n].alias(n) for n in (
        "priority_score", "frequency_score", "severity_score", "confidence_score", "priority_method")])
    quotes = F.transform(
        F.filter("evidence_quotes", lambda q: q["validation_status"] == "valid"),
        lambda q: F.struct(*[q[n].alias(n) for n in ("feedback_id", "quote", "validation_status", "source", "date", "rating")]),
    )
    return apply_decisions(ranked, decisions).select(
        "theme_name", "priority_score", "mention_count", "primary_count", "secondary_count", "feedback_percentage",
        "average_rating", "evidence_strength", "confidence", "review_status", "reviewer_note",
        components.alias("priority_components"), quotes.alias("evidence_quotes"),
        "sentiment_distribution", "severity_distribution",
        "possible_root_causes", "suggested_product_actions",
    ).orderBy(F.desc("priority_score"), F.desc("mention_count"), "theme_name")


def export_insights_json(
    ranked: DataFrame, distributions: DataFrame, feedback_ids: DataFrame, path: str,
    decisions: DataFrame | None = None, exported_at: str | None = None
) -> None:
    """JSON lines under ``path``: ``meta``, ``insights``, ``distributions`` (one line per theme, kind and value) and
    ``source_feedback_ids`` (one line per theme and id).  The insights, a row per theme, are computed once.  All four appear
    together, or, if the gate refuses a row of one of them, none."""
    ranked = stage(ranked, "ranked")
    meta = ranked.agg(
        F.lit(exported_at or _now()).alias("exported_at"), F.count(F.lit(1)).alias("total_themes"),
        F.lit(fixed.DISCLAIMER).alias("disclaimer"),
    )
    tables = {"insights": insight_documents(ranked, decisions), "distributions": distributions, "source_feedback_ids": feedback_ids, "meta": meta}
    publish(tables, path, lambda table, place: guarded(table).write.options(ignoreNullFields=False).json(place))


# --- Markdown report --------------------------------------------------------


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")


def _f(column: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_half_even(column, digits).cast("double"))


def _text_lines(df: DataFrame, block: int, lines: list[str]) -> DataFrame:
    """Fixed lines, positioned in the report."""
    rows = [(block, 0, i, 0, "", line) for i, line in enumerate(lines)]
    return df.sparkSession.createDataFrame(rows, "block int, theme_rank int, part int, item int, sort_id string, line string")


def report_lines(
    ranked: DataFrame,
    feedback_ids: DataFrame,
    total_records: int,
    analyzed_records: int,
    decisions: DataFrame | None = None,
    generated_at: str | None = None,
) -> DataFrame:
    """The report as ordered lines.

    Supporting ids take one line each, so a theme with a billion records needs
    neither a huge row nor a single task; the sort is a range partitioning.  The
    insights, a row per theme with its decision, are computed once for all parts.
    """
    decided = stage(apply_decisions(ranked, decisions), "decided")
    n = decided.count()
    order = F.array_sort(F.collect_list(F.struct(
        (-F.col("priority_score")).alias("a"), (-F.col("mention_count")).alias("b"), F.col("theme_name"))))
    # One entry per theme of the rule table: a bounded list.
    places = decided.agg(order.alias("o")).select(F.posexplode("o").alias("theme_rank", "o")).select("theme_rank", "o.theme_name")
    themes = decided.join(F.broadcast(places), "theme_name")
    part, title = F.col("priority_components"), fixed.REPORT

    head = [title["title"], "", f"{title['generated']} {generated_at or _now()}", "", title["summary"],
            f"{title['records']} {total_records}", f"{title['analyzed']} {analyzed_records}", f"{title['themes']} {n}", "",
            title["overview"], title["overview_columns"], title["overview_rule"]]
    tail = [title["methods"], *title["method_notes"], "", title["privacy"], title["privacy_note"], "", f"> {fixed.DISCLAIMER}", ""]

    def said(label: str, *parts: Column | str) -> Column:
        return F.concat(F.lit(title[label] + " "), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])

    cells = ["theme_name", _f(F.col("priority_score"), 4), "mention_count", "primary_count", "secondary_count",
             F.concat(_f(F.col("feedback_percentage"), 1), F.lit("%")), "evidence_strength", "review_status"]
    overview = themes.select(
        F.lit(1).alias("block"), "theme_rank", F.lit(0).alias("part"), F.lit(0).alias("item"), F.lit("").alias("sort_id"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cells]), F.lit(" |")).alias("line"),
    )
    facts = [
        F.concat(F.lit("### "), theme_label(F.col("theme_name"))),
        said("score", _f(F.col("priority_score"), 4)),
        F.format_string(title["components"], *[_f(part[f"{c}_score"], 4) for c in ("frequency", "severity", "confidence")]),
        F.format_string(title["mentions"], "mention_count", "primary_count", "secondary_count"),
        said("percentage", _f(F.col("feedback_percentage"), 1), F.lit("%")),
        F.format_string(title["strength"], "evidence_strength", _f(F.col("confidence"), 3)),
        said("status", "review_status"),
        F.when(F.col("reviewer_note") != "", said("note", "reviewer_note")),
        F.lit(title["ids"]),
    ]
    item = lambda text: F.concat(F.lit("  - "), text)
    quote = F.filter("evidence_quotes", lambda q: q["validation_status"] == "valid")
    quoted = F.concat(
        F.when(F.size(quote) > 0, F.array(F.lit(title["quotes"]))).otherwise(F.array().cast("array<string>")),
        F.transform(quote, lambda q: item(F.concat(F.lit("`"), q["feedback_id"], F.lit('`: "'), q["quote"], F.lit('"')))),
        F.array(F.lit(title["causes"])), F.transform("possible_root_causes", item),
        F.array(F.lit(title["actions"])), F.transform("suggested_product_actions", item),
        F.array(F.lit("")),
    )

    def section(part_no: int, lines: Column) -> DataFrame:
        return themes.select(
            F.lit(3).alias("block"), "theme_rank", F.lit(part_no).alias("part"),
            F.posexplode(F.array_compact(lines)).alias("item", "line"),
        ).select("block", "theme_rank", "part", "item", F.lit("").alias("sort_id"), "line")

    listed = F.broadcast(places).join(feedback_ids, "theme_name", "left")  # a theme without ids keeps one line
    ids = listed.select(
        F.lit(3).alias("block"), "theme_rank", F.lit(1).alias("part"), F.lit(0).alias("item"),
        F.coalesce("feedback_id", F.lit("")).alias("sort_id"), F.concat(F.lit("  - "), F.coalesce("feedback_id", F.lit(title["no_ids"]))).alias("line"),
    )
    pieces = [
        _text_lines(ranked, 0, head), overview, _text_lines(ranked, 2, ["", title["details"]]),
        section(0, F.array(*facts)), ids, section(2, quoted), _text_lines(ranked, 4, tail),
    ]
    return reduce(DataFrame.unionByName, pieces).orderBy("block", "theme_rank", "part", "item", "sort_id")


def export_report_md(path: str, *args, **kwargs) -> None:
    """Write the checked report as text files whose names keep the line order."""
    guarded(report_lines(*args, **kwargs).select("line")).write.text(path)
