"""The whole dataflow: masked feedback to ranked insights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from voxtally import fixed
from voxtally.functions.skew import lookup_join, newest
from voxtally.operators import analysis as an
from voxtally.operators import explore, insights, privacy
from voxtally.operators.groups import Clusters, cluster_feedback
from voxtally.operators.mentions import row_order
from voxtally.operators.similarity import TfidfModel, tfidf_fit
from voxtally.session import stage
from voxtally.sources.taxonomy import DEFAULT_PRESET


@dataclass
class Pipeline:
    """Results of one run.  Clusters are fitted on first use: they never influence the rest."""

    masked: DataFrame
    analysis: DataFrame
    aggregation: insights.Aggregation
    ranked: DataFrame
    model: TfidfModel | None

    @cached_property
    def clusters(self) -> Clusters:
        return cluster_feedback(self.masked, model=self.model)

    @cached_property
    def explorer(self) -> DataFrame:
        return explore.explorer_table(self.analysis, self.masked)


def mask(valid: DataFrame, materialize: bool = True) -> DataFrame:
    """Mask validated rows and drop the raw text, so nothing later can see it."""
    if "feedback_text" not in valid.columns:
        raise KeyError("There is no feedback_text to mask.")
    masked = privacy.safe_columns(privacy.mask_feedback(valid))
    return stage(masked, "masked") if materialize else masked


def run_pipeline(masked: DataFrame, preset: str = DEFAULT_PRESET, materialize: bool = True) -> Pipeline:
    """Analyse, aggregate and rank masked rows.

    The analysis feeds the aggregates, the explorer and the exports, so it is
    written once to the shared folder (``materialize=False`` keeps it lazy).
    """
    if "masked_text" not in masked.columns:
        raise KeyError(fixed.MSG_NEEDS_MASKED_ANALYSIS)
    safe = privacy.safe_columns(masked)
    model = tfidf_fit(safe)
    analysed = an.analyze_feedback(safe, preset, model=model)
    if materialize:
        analysed = stage(analysed, "analysis")
    aggregation = insights.aggregate_themes(analysed, safe, materialize)
    ranked = insights.prioritize(aggregation.insights, aggregation.total)
    return Pipeline(safe, analysed, aggregation, ranked, model)


def with_clusters(analysed: DataFrame, clusters: Clusters) -> DataFrame:
    """The analysis with each record's cluster id (the last one where an id repeats)."""
    members = clusters.members.select(
        F.col("feedback_id").cast("string").alias("feedback_id"), F.col("cluster_id"), row_order(clusters.members.drop("tfidf")).alias("_order")
    ).where("feedback_id is not null")
    ids = newest(members.where("cluster_id is not null"), "feedback_id", F.struct("_order", "cluster_id"), "cluster_id")
    return lookup_join(analysed.drop("cluster_id"), ids, "feedback_id").select(*analysed.columns)
