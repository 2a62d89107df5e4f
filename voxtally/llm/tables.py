"""Inputs, held-out folds and the staging of intermediate results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.session import new_folder

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: long texts would make Spark's default batches very large.
BATCH_ROWS = 1_000


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, unless they are told otherwise.

    Enough for local runs and for folders that all machines mount; elsewhere the package is shipped with ``--py-files``.
    Whole texts travel to the workers, so the session's Arrow batches, if they still have Spark's default of 10 000 rows, are made smaller.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """``crc32(key as text) mod folds``; a null key is in fold 0 by definition."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0))


def with_kept(docs: DataFrame, kept: Column) -> DataFrame:
    """The struct ``kept`` of what a scoring passes on, and the text beside it unless it is in there."""
    only = docs.select(kept.alias("kept"))
    return only if "text" in only.schema["kept"].dataType.names else docs.select(kept.alias("kept"), "text")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write once under ``spark.checkpoint.dir`` and read back: the lineage ends there, and a lost executor costs a read."""
    path = new_folder(df.sparkSession, label)
    reachable(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(stored: DataFrame) -> None:
    """Remove a table that ``store`` gave (or a filter or selection of it), once nothing reads it any more."""
    spark = stored.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
