"""Reading stored feedback tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is stored.  How finely it is read is set by ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(path)
