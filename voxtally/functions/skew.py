"""Joins and aggregates that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

def key_counts(df: DataFrame, key: str, count: str = "key_rows") -> DataFrame:
    """Rows per non-null key (partial aggregation runs before the shuffle)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count))


def hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed (maps cannot be)."""
    return [F.to_json(F.col(f"`{n}`")) if "map<" in t else F.col(f"`{n}`") for n, t in df.dtypes]


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a side with one row per key.

    A small right side is broadcast by Spark after it has seen its size.  Otherwise both sides are shuffled, and where
    a key, or the rows without one, fill a partition far beyond the others, adaptive execution splits the left side of that
    partition over several tasks; that needs no count of the keys beforehand and no second pass over either side.
    """
    return left.join(right, key, "left").select(*left.columns, *[c for c in right.columns if c != key])


def newest(df: DataFrame, key: str, order: Column, *columns: str, first: bool = False) -> DataFrame:
    """One row per key: the last (or first) by ``order``.

    An aggregate, not a window: a hot key is reduced inside each map task.
    """
    pick = F.min_by if first else F.max_by
    best = pick(F.struct(*columns), order).alias("_row")
    return df.groupBy(key).agg(best).select(key, *[F.col("_row")[c].alias(c) for c in columns])
