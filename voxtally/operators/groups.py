"""Exploratory K-Means groups over the TF-IDF vectors.  They never change themes or priorities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from voxtally import fixed
from voxtally.functions.exprs import normalize_text, strings
from voxtally.operators import kmeans
from voxtally.operators.similarity import TfidfModel, tfidf_fit, vector_entries, with_vectors
from voxtally.session import stage


# Columns by which members are found again; no text is among them.
KEPT = ("feedback_id", "_row_number")


@dataclass
class Clusters:
    """``members``: one row per record with ``cluster_id`` (null without text) and its vector."""

    members: DataFrame
    model: TfidfModel | None
    k: int
    warnings: list[str] = field(default_factory=list)
    centres: np.ndarray | None = None
    cost: float | None = None


def choose_k(records: int, requested: int | None = None) -> int:
    if records <= 1:
        return max(records, 0)
    wanted = requested or min(fixed.CLUSTER_DEFAULT_K, records)
    return max(1, min(wanted, fixed.CLUSTER_MAX_K, records))


def cluster_feedback(
    df: DataFrame,
    k: int | None = None,
    column: str = "masked_text",
    model: TfidfModel | None = None,
    restarts: int = fixed.CLUSTER_RESTARTS,
) -> Clusters:
    """K-Means with several seeded starts, the cheapest kept.

    Key columns and vectors are written once, without the texts.  All starts share the passes over the vectors.
    """
    usable = normalize_text(F.col(column)).isNotNull()
    no_id = F.lit(None).cast("int")
    model = model or tfidf_fit(df, column)
    records = model.documents if model else df.where(usable).count()
    if records == 0:
        return Clusters(df.withColumn("cluster_id", no_id), None, 0, [fixed.MSG_CLUSTER_NO_TEXT])
    if records == 1:
        alone = df.withColumn("cluster_id", F.when(usable, F.lit(0)))
        return Clusters(alone, None, 1, [fixed.MSG_CLUSTER_SINGLE])
    if model is None:
        return Clusters(df.withColumn("cluster_id", no_id), None, 0, [fixed.MSG_CLUSTER_NO_TERMS])
    size = choose_k(records, k)
    warnings = [fixed.MSG_CLUSTER_REDUCED] if k and size < k and records < k else []
    vectors = stage(with_vectors(df, model, column).select(*[c for c in df.columns if c in KEPT], "tfidf", usable.alias("_usable")), "vectors")
    usable = F.col("_usable")
    if size == 1:
        return Clusters(vectors.withColumn("cluster_id", F.when(usable, F.lit(0))).drop("_usable"), model, 1, warnings)
    raw = F.unwrap_udt("tfidf")
    centres, cost = kmeans.fit(vectors.where(usable), raw["indices"], raw["values"], len(model.vocabulary), size, fixed.CLUSTER_SEED, restarts)
    labelled = vectors.withColumn("cluster_id", F.when(usable, kmeans.nearest(vector_entries(F.col("tfidf")), centres)))
    return Clusters(labelled.drop("_usable"), model, size, warnings, centres, cost)


def cluster_terms(clusters: Clusters, top: int = fixed.CLUSTER_TERMS) -> DataFrame:
    """Top terms per cluster by mean weight.  The means are one vector per cluster."""
    spark = clusters.members.sparkSession
    if clusters.model is None:
        return spark.createDataFrame([], "cluster_id int, term_rank int, term string, mean_weight double")
    means = (
        clusters.members.where("cluster_id is not null")
        .groupBy("cluster_id")
        .agg(Summarizer.mean(F.col("tfidf")).alias("mean"))
        .select("cluster_id", F.posexplode(vector_to_array("mean")).alias("term_index", "mean_weight"))
        .where("mean_weight > 0")
    )
    order = Window.partitionBy("cluster_id").orderBy(F.desc("mean_weight"), F.desc("term_index"))
    ranked = means.withColumn("term_rank", F.row_number().over(order)).where(F.col("term_rank") <= top)
    names = F.broadcast(clusters.model.term_table(spark).select("term_index", "term"))
    return ranked.join(names, "term_index").select("cluster_id", "term_rank", "term", "mean_weight")


def cluster_summary(clusters: Clusters) -> DataFrame:
    """One row per cluster; its members are the rows of ``Clusters.members``."""
    sizes = clusters.members.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    ranked = F.array_sort(F.collect_list(F.struct("term_rank", "term")))
    best = cluster_terms(clusters).groupBy("cluster_id").agg(F.transform(ranked, lambda t: t["term"]).alias("representative_terms"))
    return sizes.join(best, "cluster_id", "left").select(
        "cluster_id",
        "cluster_size",
        F.coalesce("representative_terms", strings([])).alias("representative_terms"),
        F.lit(fixed.MSG_CLUSTER).alias("warning"),
    ).orderBy("cluster_id")
