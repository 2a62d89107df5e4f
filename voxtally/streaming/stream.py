"""Structured Streaming: the row-local operators unchanged, and a daily theme trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from voxtally import fixed
from voxtally.operators.analysis import analyze_feedback, analyze_rows
from voxtally.operators.privacy import mask_feedback, safe_columns
from voxtally.operators.quality import row_status, valid_rows
from voxtally.operators.similarity import TfidfModel
from voxtally.sources.taxonomy import DEFAULT_PRESET


def read_feedback_stream(
    spark: SparkSession, folder: str, schema, files: str = "*", files_per_trigger: int | None = None, fmt: str = "parquet",
    tasks: int | None = None,
) -> DataFrame:
    """New files of a folder whose names match the pattern ``files``.

    ``tasks`` deals the rows of each batch out anew: for few large files that cannot be split, before costly row work.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.format(fmt).load(folder)
    return rows.repartition(tasks) if tasks else rows


def clean_stream(feedback: DataFrame) -> DataFrame:
    """Row checks only: whether an id or text repeats is not known while rows still arrive."""
    return valid_rows(row_status(feedback))


def analyze_stream(
    feedback: DataFrame, preset: str = DEFAULT_PRESET, event_time: str | None = None, model: tuple[TfidfModel, int] | None = None
) -> DataFrame:
    """Mask and classify rows as they come.

    The similarity fallback needs a vocabulary, which rows that are still to come can't give: with ``model``, a saved one and its version as
    ``load_model`` gives them, the rows are those of a batch with that model, and ``model_version`` tells which it was.  Without, only the keyword rules
    apply.  ``event_time`` names a timestamp column to carry along for windows.
    """
    masked = safe_columns(mask_feedback(feedback))
    stamped = masked if event_time is None else masked.withColumn("_row_number", F.col(event_time))
    rows = analyze_rows(stamped, preset) if model is None else analyze_feedback(stamped, preset, model=model[0]).withColumn("model_version", F.lit(model[1]))
    return rows if event_time is None else rows.withColumnRenamed("_row_number", event_time)


def stream_trend(analysed: DataFrame, event_time: str, late: str = "1 day") -> DataFrame:
    """Mentions per theme and day; a record counts once per theme, rows later than the watermark allows are dropped.

    Meant for ``write_updates``: every day is there from its first record on, the last days included.
    """
    names = F.array_distinct(F.concat(F.array("primary_theme"), F.transform("secondary_themes", lambda s: s["theme"])))
    return (
        analysed.withWatermark(event_time, late)
        .select("feedback_id", event_time, F.explode(names).alias("theme_name"))
        .where(~F.col("theme_name").isin(*fixed.UNCOUNTED_THEMES))
        .dropDuplicatesWithinWatermark(["feedback_id", "theme_name"])
        .groupBy(F.window(event_time, "1 day"), "theme_name")
        .agg(F.count(F.lit(1)).alias("records"))
        .select("theme_name", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "records")
    )


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed rows as Parquet, marked with the batch; see ``latest_updates``.

    A batch that is repeated after a failure writes the same rows under the same number, so the latest state stays right.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_updates(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Exactly-once Parquet output of everything available now."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
