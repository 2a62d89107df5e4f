"""An explorer table on disk that filters and searches read in part.

Rows lie in blocks of similar rows: they are ordered along a Z-curve over theme, sentiment, severity and source, cut into ranges, and each range is a folder, so a choice of
blocks is partition pruning. Two index tables go with them: for each filter value a bitmap of the blocks that hold it, and for each trigram of the searchable texts
the blocks that hold it, sorted by trigram. A regex is searched in those blocks only that hold all trigrams that its matches must have; one without any reads all. What is read
is filtered as ever, so the rows are those of ``filter_explorer`` and ``search_explorer``.
"""

from __future__ import annotations

import json
import re
from itertools import product
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxtally.operators import explore
from voxtally.session import stage

#: Rows of a block, about.
ROWS = 100_000
CLUSTERED = ("primary_theme", "sentiment", "severity", "source")
LISTED = ("primary_theme", "sentiment", "severity", "intent", "source", "analysis_method", "requires_human_review", "pii_detected")
#: Bits of each column in the Z-value; alternatives of a regex beyond which it is searched everywhere.
BITS, ALTERNATIVES = 6, 32


def z_value(columns: Sequence[str]) -> Column:
    """The bits of the columns' hashes, interleaved."""
    value = F.lit(0).cast("long")
    for place, c in enumerate(columns):
        hashed = F.pmod(F.hash(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << BITS)).cast("long")
        for b in range(BITS):
            bit = F.shiftright(hashed, b).bitwiseAND(F.lit(1).cast("long"))
            value = value + F.shiftleft(bit, b * len(columns) + place)
    return value


def _searchable(df: DataFrame) -> list[str]:
    return [c for c in explore.SEARCHED if c in df.columns]


def trigrams(column: Column) -> Column:
    """All trigrams of the lower-case text, in one pass (``substring`` would count its way from the start each time)."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(column), F.lit("(?s)(?=(...))"), F.lit(1)), F.array().cast("array<string>")))


def needed_trigrams(pattern: str) -> list[set[str]] | None:
    """Sets of trigrams of which every match holds at least one whole set; None if there is nothing to go by.

    Only plain syntax is looked into; what might mean something else to Spark's regex engine gives None.
    """
    if "(?" in pattern or "&&" in pattern or "[[" in pattern or re.search(r"\\(?![bdws.()\[\]{}|*+?^$\\/-])", pattern) or re.search(r"[*+?}]\+", pattern):
        return None
    try:
        tree = re._parser.parse(pattern)
    except (re.error, AttributeError, OverflowError):
        return None

    def of(items) -> list[frozenset[str]] | None:
        found, run = [frozenset()], ""
        for op, arg in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            if name == "AT":  # takes no room
                continue
            own = frozenset(run[i: i + 3] for i in range(len(run) - 2))
            found, run = [s | own for s in found], ""
            below = None
            if name == "SUBPATTERN":
                below = of(arg[3])
            elif name == "BRANCH":
                parts = [of(p) for p in arg[1]]
                below = None if None in parts else [s for p in parts for s in p]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                below = of(arg[2]) if arg[0] >= 1 else [frozenset()]
            elif name in ("IN", "ANY", "NOT_LITERAL", "None"):
                below = [frozenset()]
            if below is None or len(found) * len(below) > ALTERNATIVES:
                return None
            found = [a | b for a, b in product(found, below)]
        return found

    sets = of(tree)
    return None if sets is None or not all(sets) else [set(s) for s in sets]


def write(table: DataFrame, path: str, rows: int = ROWS) -> IndexedExplorer:
    """Write an explorer table with its indexes. Nulls are in no index, as no filter or search finds them; an empty table is allowed."""
    spark = table.sparkSession
    held = stage(table, "explorer")
    count = max(1, -(-held.count() // rows))
    ordered = held.withColumn("_z", z_value(CLUSTERED)).repartitionByRange(count, "_z", F.hash("feedback_id")).sortWithinPartitions("_z")
    ordered.drop("_z").withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/rows")
    spark.createDataFrame([(table.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
    found = IndexedExplorer(spark, path)
    written = found.rows()
    grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c).cast("string")) for c in _searchable(table)])))
    pairs = written.select("block", F.explode(grams).alias("gram")).distinct()
    pairs.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in LISTED if c in table.columns])
    listed = written.select("block", F.inline(values)).where("value is not null").distinct()
    place = F.col("block").cast("long") + 1  # bitmaps count from 1
    bits = listed.groupBy("column", "value", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("blocks"))
    bits.write.parquet(f"{path}/values")
    return found


class IndexedExplorer:
    """An explorer table written by ``write``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()["value"]))
        return self.spark.read.schema(schema.add("block", T.IntegerType())).parquet(f"{self.path}/rows")

    def _holding(self, column: str, wanted: Sequence[str]) -> set[int]:
        """Blocks with one of the values: at most one bitmap for each 32 768 blocks reaches the driver."""
        table = self.spark.read.schema("column string, value string, bucket long, blocks binary").parquet(f"{self.path}/values")
        found = table.where((F.col("column") == column) & F.col("value").isin(*wanted)).groupBy("bucket").agg(F.bitmap_or_agg("blocks").alias("blocks"))
        out: set[int] = set()
        for r in found.collect():
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(r["blocks"], np.uint8), bitorder="little"))
            out.update(((r["bucket"] - 1) * 32_768 + bits).tolist())
        return out

    def _matching(self, pattern: str) -> set[int] | None:
        sets = needed_trigrams(pattern)
        if sets is None:
            return None
        table = self.spark.read.schema("block int, gram string").parquet(f"{self.path}/grams")
        near = table.where(F.col("gram").isin(*sorted(set().union(*sets)))).groupBy("block").agg(F.collect_set("gram").alias("grams"))
        whole = [F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in sorted(s)]))) == len(s) for s in sets]
        return {r["block"] for r in near.where(F.greatest(*[w.cast("int") for w in whole], F.lit(0)) == 1).select("block").collect()}

    def blocks(self, search_query: str = "", human_review: str | None = None, pii_detected: str | None = None, **lists: Sequence[str]) -> list[int] | None:
        """Numbers of the blocks that may hold a row that is asked for; None: all. A number for each such block reaches the driver."""
        wanted = [(explore.LISTS[name], values) for name, values in lists.items() if values]
        wanted += [(c, ["true" if answer == "Yes" else "false"]) for c, answer in (("requires_human_review", human_review), ("pii_detected", pii_detected)) if answer in ("Yes", "No")]
        found = [self._holding(c, values) for c, values in wanted]
        if pattern := search_query.strip().lower():
            matching = self._matching(pattern)
            found += [] if matching is None else [matching]
        return sorted(set.intersection(*found)) if found else None

    def filter(self, **filters) -> DataFrame:
        """``filter_explorer`` with the same arguments, over the blocks that matter."""
        chosen, rows = self.blocks(**filters), self.rows()
        if chosen is not None:
            rows = rows.where(F.col("block").isin(*chosen)) if chosen else rows.where(F.lit(False))
        return explore.filter_explorer(rows, **filters).drop("block")

    def search(self, query: str) -> DataFrame:
        return self.filter(search_query=query)
