"""Near-duplicate texts: an exact Jaccard join over word shingles by T-occurrence search.

1. Each text becomes the set of its hashed shingles; texts with equal sets are one node from here on.
2. Shingles get one global order: rare ones first, as far as a list of bounded size tells, then by hash. Two similar sets
   differ in so few shingles that two neighbours in that order are common neighbours of both, near the front (``front``). Sets
   that share such a pair and may match by size are chained. So no match crosses the chains, and their components are the cells of the search.
3. In each cell (large ones in pairs of blocks) an inverted index answers a T-occurrence query for each set: DivideSkip merges the short lists,
   probes the longest ones by binary search and keeps the sets that reach the required overlap.
4. The links' components are the groups. Only spanning links leave a task, never all pairs of a group.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.components import components
from voxtally.llm.flat import LOWER, mix, slices, span_hashes, text_bytes, word_spans
from voxtally.llm.tables import partitions, store

#: Words of a shingle and similarity in percent that link two texts, where the caller names none.
WORDS, PERCENT = 3, 90
#: Frequent shingles that are told apart from the rest. More would only mean fewer sets in a cell, never other results.
FREQUENT = 1 << 18
#: Entries of a task that are combined at once.
ENTRIES = 1_000_000
#: Sets and shingles in a block of a cell.
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 500_000
#: Residues by which sets outside all cells are told from the others before they are moved.
RESIDUES = 1 << 22
#: The longest lists of a query are probed, as many as T / (MU * log2(longest) + 1).
MU = 0.02


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the sorted set of each text, the id of each set)."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(LOWER[data], starts, ends)
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h ^ words[k: k + n]) + np.uint64(k + 1)
    out, ids = [], np.zeros(batch.num_rows, np.int64)
    none = np.zeros(0, np.uint64)
    for i in range(batch.num_rows):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.sort(h[a: b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(whole ^ np.array([w])) + np.uint64(77)
            own = np.asarray(whole, np.uint64).reshape(1)
        else:
            own = none
        out.append(own)
        if len(own):
            ids[i] = mix(np.array([own.sum() + np.uint64(len(own))]) ^ mix(np.array([np.bitwise_xor.reduce(own)]))).view(np.int64)[0]
    return out, ids


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    for whole in batches:
        for batch in slices(whole):
            yield batch, *shingle_sets(batch, words)


def _base(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each shingle that several sets of this task hold (kind 1: key is the shingle, n the sets)."""
        held: list[np.ndarray] = []
        seen: set[int] = set()
        for batch, sets, ids in _texts(batches, words):
            n = np.array([len(s) for s in sets], np.int32)
            yield pa.record_batch({"kind": pa.array(np.zeros(len(n), np.int8)), "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n": pa.array(n), "key": pa.array(ids)})
            for own, key in zip(sets, ids.tolist()):
                if key not in seen and len(own):
                    seen.add(key)
                    held.append(own)
            if sum(map(len, held)) > ENTRIES:
                yield _repeated(held)
                held = []
        yield _repeated(held)

    return run


def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(every)))
    keys, n = every[begin][count > 1].view(np.int64), count[count > 1]
    nulls = pa.nulls(len(keys), pa.int64())
    return pa.record_batch({"kind": pa.array(np.ones(len(keys), np.int8)), "row": nulls, "doc_id": nulls, "n": pa.array(n.astype(np.int32)), "key": pa.array(keys)})


def _order(own: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort keys of shingles: the class of a frequent one (0: none), then the hash."""
    at = np.searchsorted(listed, own)
    at[at == len(listed)] = 0
    kind = np.where(listed[at] == own, rank[at], 0).astype(np.uint64) if len(listed) else np.zeros(len(own), np.uint64)
    return (kind << np.uint64(56)) | (own >> np.uint64(8))


def front(n: int, percent: int) -> int:
    """How many of a set's first shingles must be looked at for neighbours.

    Let a set of n share all but e of its shingles with another that has e2 more. Similarity t means e <= (1 - t) n and
    e2 <= (n - e) / t - n; from t = 3/4 on, sets that differ at all have e + e2 + 2 shingles in common. Of the first e + e2 + 2 common shingles, two follow each other with none of the e + e2 others between them;
    that is at place e + e2 + 2 of the common ones, and at 2 e + e2 + 2 of this set, at the latest. The sum grows with e.
    """
    e = n * (100 - percent) // 100
    return min(n, 2 * e + (n - e) * 100 // percent - n + 2)


def smallest(percent: int) -> int:
    """Sets of fewer shingles match equal sets only."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 30


def _chain(sig: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, sorted by (sig, lo), begin a chain: another key, or sizes too far from all before."""
    if not len(sig):
        return np.zeros(0, bool)
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    group = np.cumsum(new)
    top = np.maximum.accumulate(group * (1 << 40) + hi) - group * (1 << 40)
    new[1:] |= lo[1:] * percent > top[:-1] * 100
    return new


def _signatures(frequent, words: int, percent: int):
    """For each set the pairs of neighbours near its front, combined in the task: a chain's first set stands for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, rank = frequent.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def combined() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig, node, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((n, sig))
            sig, node, n = sig[order], node[order], n[order]
            begin = np.flatnonzero(_chain(sig, n, n, percent))
            count = np.diff(np.append(begin, len(sig)))
            last = begin + count - 1
            yield _rows(sig[begin], node[begin], n[begin], n[last], None)
            head = np.repeat(node[begin], count)
            apart = head != node
            pairs = np.unique(np.column_stack([head[apart], node[apart]]), axis=0)
            yield _rows(pairs[:, 1], pairs[:, 0], np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), pairs[:, 1])

        for _, sets, ids in _texts(batches, words):
            for own, key in zip(sets, ids.tolist()):
                if len(own) < smallest(percent) or key in seen:
                    continue
                seen.add(key)
                first = front(len(own), percent)
                keys = _order(own, listed, rank)
                keys = np.sort(np.partition(keys, first - 1)[:first]) if first < len(keys) else np.sort(keys)
                sig = mix(mix(keys[:-1]) ^ keys[1:]).view(np.int64)
                held.append((sig, np.full(len(sig), key), np.full(len(sig), len(own))))
            if sum(len(x[0]) for x in held) > ENTRIES:
                yield from combined()
        yield from combined()

    return run


def _rows(sig: np.ndarray, head: np.ndarray, lo: np.ndarray, hi: np.ndarray, member: np.ndarray | None) -> pa.RecordBatch:
    return pa.record_batch({
        "sig": pa.array(sig), "head": pa.array(head), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)),
        "member": pa.nulls(len(sig), pa.int64()) if member is None else pa.array(member)})


def _join_chains(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tie the heads of each chain; rows come sorted by (sig, lo), and a chain goes on from batch to batch."""
        carry = None
        for batch in batches:
            member = batch.column("member")
            if member.null_count < len(member):
                ready = batch.filter(member.is_valid())
                yield pa.record_batch({"a": ready.column("head"), "b": ready.column("member")})
                batch = batch.filter(member.is_null())
            if not batch.num_rows:
                continue
            sig, head, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sig", "head", "lo", "hi"))
            if carry is not None:
                sig, head, lo, hi = (np.concatenate(([c], x)) for c, x in zip(carry, (sig, head, lo, hi)))
            begin = np.flatnonzero(_chain(sig, lo, hi, percent))
            count = np.diff(np.append(begin, len(sig)))
            first = np.repeat(head[begin], count)
            apart = first != head
            if apart.any():
                pairs = np.unique(np.column_stack([first[apart], head[apart]]), axis=0)
                yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})
            tail = begin[-1]
            carry = (sig[-1], head[tail], lo[tail], hi[tail:].max())

    return run


def _candidates(wanted, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for _, sets, ids in _texts(batches, words):
            picked = []
            for i, key in enumerate(ids.tolist()):
                if len(sets[i]) >= smallest(percent) and bits[key % RESIDUES] and key not in seen:
                    seen.add(key)
                    picked.append(i)
            if picked:
                yield pa.record_batch({"node": pa.array(ids[picked]), "shingles": pa.array([sets[i].tobytes() for i in picked], pa.binary())})

    return run


class Index:
    """Inverted lists of a few sets, as one sorted array of (shingle number, set number)."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray):
        owner = np.repeat(numbers, [len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.lexsort((owner, every))
        self.docs, every = owner[order], every[order]
        begin = np.concatenate(([True], every[1:] != every[:-1]))
        self.shingles = every[begin]
        self.begins = np.append(np.flatnonzero(begin), len(every))
        self.width = int(numbers.max()) + 1
        self.keys = (np.cumsum(begin) - 1) * self.width + self.docs

    def search(self, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that hold at least ``least`` of the shingles, with how many: DivideSkip."""
        none = np.zeros(0, np.int64)
        at = np.searchsorted(self.shingles, own)
        at[at == len(self.shingles)] = 0
        lists = at[self.shingles[at] == own]
        if len(lists) < least:
            return none, none
        lengths = self.begins[lists + 1] - self.begins[lists]
        order = np.argsort(-lengths, kind="stable")
        lists, lengths = lists[order], lengths[order]
        long = min(least - 1, int(least / (MU * np.log2(max(2, lengths[0])) + 1)))
        short, size = lists[long:], lengths[long:]
        total = np.cumsum(size)
        merged = np.sort(self.docs[np.arange(total[-1]) + np.repeat(self.begins[short] - (total - size), size)], kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        count = np.diff(np.append(begin, len(merged)))
        ok = count >= least - long
        found, count = merged[begin][ok], count[ok]
        if len(found) and long:
            probes = lists[:long, None] * self.width + found[None, :]
            place = np.searchsorted(self.keys, probes)
            place[place == len(self.keys)] = 0
            count = count + (self.keys[place] == probes).sum(0)
        reached = count >= least
        return found[reached], count[reached]


def _search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        block = table.column("block").to_numpy()
        cell = np.unique(table.column("cell").to_numpy(), return_inverse=True)[1]
        across = block.min() != block.max()
        numbers = np.arange(len(sets))
        indexed = np.flatnonzero(block == block.min())
        asking = np.flatnonzero(block != block.min()) if across else numbers
        index = Index([sets[i] for i in indexed], indexed)
        label, members = numbers.copy(), np.bincount(cell)
        joined = np.ones(len(sets), np.int64)  # sets in the group of this label
        links = []
        for q in asking:
            if joined[label[q]] == members[cell[q]]:
                continue  # all of its cell is in its group already
            found, common = index.search(sets[q], -(-percent * size[q] // 100))
            ok = (100 * common >= percent * (size[q] + size[found] - common)) & (label[found] != label[q])
            for other in found[ok]:
                a, b = label[q], label[other]
                if a != b:
                    label[label == b] = a
                    joined[a] += joined[b]
                    links.append((node[q], node[other]))
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``row, doc_id, n_shingles, node, component_id`` for each document; ``row`` is its ``monotonically_increasing_id``.

    Sets: distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; fewer words are one shingle. Two documents link when
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id of the linked documents (null only if all
    their ids are). Null texts and texts without words have an empty set and their own id. Repeated rows are linked like any equal texts.
    An empty table gives no rows; other columns are ignored. ``docs`` is read several times and must come from a table.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the search is exact from 75 percent on")
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = store(texts.mapInArrow(_base(words), "kind byte, row long, doc_id long, n int, key long"), "shingle-base")
    rows = base.where("kind = 0").select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("node"))

    # Classes of the most frequent shingles; their number is bounded, so they can be broadcast.
    counted = store(base.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).select("key", F.ceil(F.log2("n") * 4).cast("int").alias("class")), "shingle-counts")
    below, room = 0, FREQUENT
    for r in counted.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect():
        room -= r["n"]
        if room < 0:
            below = r["class"]
            break
    frequent = counted.where(F.col("class") > below).toArrow()
    listed = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(listed)
    shared = spark.sparkContext.broadcast((listed[order], np.minimum(frequent.column("class").to_numpy(), 255)[order]))

    plain = docs.select("text")
    signed = plain.mapInArrow(_signatures(shared, words, percent), "sig long, head long, lo int, hi int, member long")
    sorted_rows = signed.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "lo")
    cells = store(components(sorted_rows.mapInArrow(_join_chains(percent), "a long, b long"), "a", "b"), "cells")

    sizes = rows.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"))
    sized = cells.join(sizes.select("node", "n"), "node")
    weight = sized.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    weight = store(weight.withColumn("blocks", blocks.cast("int")), "cell-weights")
    small = weight.where("blocks = 1").agg(F.sum("sets"), F.sum("shingles")).first()
    bins = max(1, -(-(small[0] or 0) // BLOCK_SETS), -(-(small[1] or 0) // BLOCK_SHINGLES))
    placed = cells.join(weight.select("component", "blocks"), "component")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("block", own).withColumn("other", other)
    shared_bin = F.pmod(F.xxhash64("component"), F.lit(bins))
    task = F.when(F.col("blocks") == 1, shared_bin).otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    placed = placed.select("node", F.col("component").alias("cell"), "block", task.alias("task"))

    residues = cells.select(F.pmod("node", F.lit(RESIDUES)).cast("int").alias("r")).distinct().toArrow().column("r").to_numpy()
    bits = np.zeros(RESIDUES, bool)
    bits[residues] = True
    sets = plain.mapInArrow(_candidates(spark.sparkContext.broadcast(bits), words, percent), "node long, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    links = sets.join(placed, "node").groupBy("task").applyInArrow(_search(percent), "a long, b long")
    groups = store(components(links, "a", "b"), "groups")

    node_group = sizes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("g"))
    smallest = node_group.groupBy("g").agg(F.min("least").alias("component_id"))
    answer = node_group.where("g is not null").join(smallest, "g").select("node", "component_id", "g")
    out = rows.join(answer, "node", "left")
    return out.select("row", "doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "g")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one with the smallest id (a null id last), then the first row. All columns stay as they are."""
    grouped = store(group(docs, words, percent).where("n_shingles > 0").select("row", "doc_id", "g"), "text-groups")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best")
    # Written by itself, so that the join below can split the rows of a group with very many copies.
    several = store(grouped.groupBy("g").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    dropped = grouped.join(several.select("g", F.col("best.row").alias("stays")), "g").where("row <> stays").select(F.col("row").alias("_row"))
    numbered = docs.select(F.struct("*").alias("kept"), F.monotonically_increasing_id().alias("_row"))
    return numbered.join(dropped, "_row", "left_anti").select("kept.*")
