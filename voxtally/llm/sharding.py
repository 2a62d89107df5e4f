"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.llm.tables import partitions

#: Rounds of the Feistel network; four already give a pseudo-random permutation.
ROUNDS = 6
#: Walks that stay in generated code, and those that follow for the few rows (under 2 ** -INLINE) that need more.
INLINE, LONGER = 3, 1024
#: Copies of one row that are numbered together.
CHUNK = 50_000


def _round(value: Column, key: int, bits: int) -> Column:
    return F.xxhash64(value, F.lit(key)).bitwiseAND(F.lit((1 << bits) - 1))


def feistel(number: Column, width: int, seed: int, inverse: bool = False) -> Column:
    """Permute the ``width``-bit numbers. The halves may differ by one bit: each round changes one half by a hash of the other."""
    low = width // 2
    high = width - low
    left, right = F.shiftrightunsigned(number, low), number.bitwiseAND(F.lit((1 << low) - 1))
    for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS)):
        key = seed * 1_000_003 + i
        if i % 2 == 0:
            left = left.bitwiseXOR(_round(right, key, high))
        else:
            right = right.bitwiseXOR(_round(left, key, low))
    return F.shiftleft(left, low).bitwiseOR(right)


def permute(df: DataFrame, number: str, out: str, rows: int, seed: int = 0, inverse: bool = False) -> DataFrame:
    """Add ``out``: the place of ``number`` in a permutation of 0 .. rows - 1.

    The network permutes 2 ** w >= rows numbers; a result outside the range is permuted again (cycle walking), which gives a
    permutation of the range. As 2 ** w < 2 * rows, each walk leaves under half of the rows outside, so under 2 ** -1000 are left
    after the last; such a row would raise an error, never give a wrong number.
    """
    width = max(2, (rows - 1).bit_length())
    step = functools.partial(feistel, width=width, seed=seed, inverse=inverse)
    outside = F.col(out) >= rows
    df = df.withColumn(out, step(F.col(number)))
    for _ in range(INLINE):
        df = df.withColumn(out, F.when(outside, step(F.col(out))).otherwise(F.col(out)))
    walks = F.when(outside, F.sequence(F.lit(1), F.lit(LONGER))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(out, F.reduce(walks, F.col(out), lambda p, _: F.when(p >= rows, step(p)).otherwise(p)))
    return df.withColumn(out, F.when(outside, F.raise_error(F.lit("cycle walking did not end"))).otherwise(F.col(out)))


def number_rows(df: DataFrame, keys: list[str], rows: int, per_bucket: int = 100_000) -> DataFrame:
    """Number the rows from 0 by their content, whatever the files and partitions they come from.

    Equal rows are counted before anything is shuffled, so a row with very many copies is one record here. Distinct rows fall into
    hash buckets of about ``per_bucket``; a running count over the buckets (their number is rows / per_bucket, and only two numbers
    each are broadcast) gives each bucket its first number, a window inside the bucket the rest. Copies get consecutive numbers.
    """
    buckets = max(1, -(-rows // per_bucket))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    distinct = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket)
    inside = Window.partitionBy("_bucket").orderBy(F.xxhash64(*keys, F.lit(1)), *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = distinct.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_first"))
    base = distinct.withColumn("_upto", F.sum("_copies").over(inside)).join(starts, "_bucket")
    base = base.withColumn("_base", F.col("_first") + F.col("_upto") - F.col("_copies"))
    last, zero = F.col("_copies") - 1, F.lit(0).cast("long")
    chunks = base.withColumn("_chunk", F.explode(F.sequence(zero, last, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition(partitions(df.sparkSession))  # the chunks of a row with very many copies go to many tasks
    copies = chunks.withColumn("_copy", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + CHUNK - 1, last))))
    return copies.select(*keys, (F.col("_base") + F.col("_copy")).alias("row_number"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number``.

    A document's global row number, permuted, is its place; place mod ``shards`` is the shard, place div ``shards`` the slot. So the
    shards' counts differ by one at most (law ``rows``), slots have no gaps, and both can be computed from the row number alone.
    ``size`` is the UTF-8 length plus 1. Null texts count as empty (crc32 0); null ids are kept as null; repeated rows get places
    of their own; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    total = docs.count()
    placed = permute(number_rows(rows, ["doc_id", "size", "text_crc32"], total), "row_number", "_place", total, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def row_numbers_of(placed: DataFrame, rows: int, shards: int = 16, seed: int = 0) -> DataFrame:
    """The way back: add ``origin``, the global row number computed from shard and slot."""
    place = (F.col("slot") * shards + F.col("shard")).cast("long")
    return permute(placed.withColumn("_place", place), "_place", "origin", rows, seed, inverse=True).drop("_place")
