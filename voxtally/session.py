"""Session settings and fault-tolerant staging of intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "voxtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Partition counts are left to AQE: a high initial count lets it coalesce
    small shuffles and split skewed ones.  Everything can be overridden.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, unless they are told otherwise; on a cluster without a
    folder that all machines mount, the package is shipped with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session without that setting can only go on in local mode, where a single machine
    sees all files: it then gets a folder of its own.  On a cluster it is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not re.match(r"local($|\[)", context.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="voxtally-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new place for a result; all places of an application are in one folder, which can go when the application has ended."""
    return f"{shared_dir(spark).rstrip('/')}/voxtally/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application has staged.  To be called when none of its results is needed any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_folder(spark, "any")).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one costly result feeds several consumers: the lineage is cut,
    later scans are columnar and pruned, and a lost executor costs a re-read.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
