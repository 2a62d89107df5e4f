"""Connected components of a graph that is held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtally.llm.tables import store


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternates two steps until no edge changes: each node's larger neighbours are tied to its smallest neighbour (large star), then its smaller
    ones are (small star). Both keep the components, the number of edges never grows, and the rounds grow with the logarithm of the longest
    path. Each round ends in a written table. A neighbourhood is only ever reduced to its minimum, which is pre-aggregated, and
    joined back, so a hub with very many neighbours costs no task more than its share.
    """
    links = store(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "links")
    while True:
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = store(large, "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(low, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi")
        after = store(tied.union(low.select(F.col("m").alias("lo"), "hi")).distinct(), "small-star")
        before_sum, after_sum = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first() for x in (links, after))
        links = after
        if tuple(before_sum) == tuple(after_sum):
            break
    member = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return member.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
