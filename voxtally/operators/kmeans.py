"""K-Means over sparse vectors, all starts in the same passes.

Vectors are packed once into rows of 1 KB. A pass reads each row once and serves every start: it draws candidates for the first centres, weighs them, or assigns the
vectors and sums them up by start and cluster. First centres are chosen as in k-means||: each of two steps draws 2 k vectors for each start, with probabilities by
their squared distance from what is drawn already (the smallest of -ln(u) / d squared, so exactly that many), and k of them are kept by weighted k-means++.
What reaches the driver is a row for each start, cluster and component; its number does not depend on the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.functions.exprs import constant
from voxtally.session import importable, stage

STEPS, ROUNDS, TOLERANCE = 2, 20, 1e-4
#: Products that a task holds at once, few enough for the cache of a core (a text is taken whole).
CELLS = 25_000
#: Bytes of the vectors of a stored row (a vector is taken whole): readers and writers hold rows by the thousand, however large these are.
ROW_BYTES = 1024
#: Vectors and components that a task works on at once (a vector is taken whole).
VECTORS, COMPONENTS = 10_000, 500_000
_BLOCK = "rows binary, indices binary, values binary, numbers binary"
_FOUND = "kind string, start int, cluster int, dim int, value double, indices binary, weights binary"


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each list or binary value of an Arrow array begins in its data, and where the last one ends."""
    if not len(lists):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(lists.type) or pa.types.is_large_list(lists.type)
    return np.frombuffer(lists.buffers()[1], np.int64 if wide else np.int32)[lists.offset: lists.offset + len(lists) + 1].astype(np.int64)


def _binary(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of some numbers, a value for each part between two cuts."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts * numbers.itemsize), pa.py_buffer(np.ascontiguousarray(numbers))]).cast(pa.binary())


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """The numbers of all values of a binary column, one after the other as Arrow holds them."""
    ends = _offsets(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]: ends[-1]].view(kind) if ends[0] < ends[-1] else np.zeros(0, kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("i")
        if batch.num_rows:
            begins = _offsets(lists)
            begins = begins - begins[0]
            place = 12 * (begins[:-1] + np.arange(len(lists))) // ROW_BYTES
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(lists)]))
            yield pa.record_batch({
                "rows": _binary(np.diff(begins).astype(np.int32), cuts),
                "indices": _binary(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), begins[cuts]),
                "values": _binary(batch.column("v").flatten().to_numpy(zero_copy_only=False), begins[cuts]),
                "numbers": _binary(batch.column("h").to_numpy(zero_copy_only=False), cuts)})


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(components of each vector, indices, values, hashes) of some vectors at a time."""
    sizes, indices, values, numbers = (_numbers(batch.column(c), kind) for c, kind in (("rows", np.int32), ("indices", np.int32), ("values", np.float64), ("numbers", np.int64)))
    begins = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, min(at + VECTORS, int(np.searchsorted(begins, begins[at] + COMPONENTS, side="right")) - 1))
        yield sizes[at:end], indices[begins[at]: begins[end]], values[begins[at]: begins[end]], numbers[at:end]
        at = end


def _pass(kind: str, shared, dims: int, draw: int, seed: int):
    """What a task does with its blocks; ``shared`` holds for each start a matrix of centres, one a row (``kind``: draw, weigh or assign)."""

    def distances(matrix, sizes, indices, values, square, own):
        """Squared distances of all vectors from some centres."""
        begins = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty((len(sizes), len(matrix)))
        turned = np.ascontiguousarray(matrix.T)
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + CELLS // max(1, len(matrix)), side="right")) - 1)
            some = np.arange(at, end)[sizes[at:end] > 0]
            dot = np.zeros((end - at, len(matrix)))
            if len(some):
                part = turned[indices[begins[at]: begins[end]]] * values[begins[at]: begins[end], None]
                dot[some - at] = np.add.reduceat(part, begins[some] - begins[at], axis=0)
            out[at:end] = own[at:end, None] - 2 * dot + square
            at = end
        return np.maximum(out, 0)

    def run(batches):
        starts = shared.value
        ranges = np.concatenate(([0], np.cumsum([len(m) for m in starts])))
        matrix = np.concatenate(starts) if ranges[-1] else np.zeros((0, dims))
        square = (matrix * matrix).sum(1)
        best = [[] for _ in starts]
        sums, counts, costs = {}, np.zeros(ranges[-1]), np.zeros(len(starts))
        for batch in batches:
            for sizes, indices, values, numbers in _portions(batch):
                begins = np.concatenate(([0], np.cumsum(sizes)))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                own = np.bincount(owner, weights=values * values, minlength=len(sizes))
                far = distances(matrix, sizes, indices, values, square, own) if ranges[-1] else np.zeros((len(sizes), 0))
                for s in range(len(starts)):
                    mine = far[:, ranges[s]: ranges[s + 1]]
                    if kind == "draw":
                        bits = (numbers.view(np.uint64) ^ np.uint64((seed * 1_000 + s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                        bits = (bits ^ (bits >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                        u = ((bits ^ (bits >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2.0 ** 53
                        weight = mine.min(1) if mine.shape[1] else np.ones(len(sizes))
                        keys = np.full(len(sizes), np.inf)
                        np.divide(-np.log(np.maximum(u, 1e-300)), weight, out=keys, where=weight > 1e-12)
                        for r in np.argsort(keys, kind="stable")[:draw]:
                            if keys[r] < np.inf:
                                best[s].append((float(keys[r]), indices[begins[r]: begins[r + 1]].tobytes(), values[begins[r]: begins[r + 1]].tobytes()))
                        best[s] = sorted(best[s])[:draw]
                        continue
                    label = mine.argmin(1)
                    counts[ranges[s]: ranges[s + 1]] += np.bincount(label, minlength=mine.shape[1])
                    costs[s] += mine[np.arange(len(sizes)), label].sum()
                    if kind == "assign":
                        total = np.bincount(label[owner] * dims + indices, weights=values, minlength=mine.shape[1] * dims)
                        sums[s] = sums.get(s, 0) + total
        rows = []
        for s in range(len(starts)):
            rows += [("drawn", s, None, None, key, i, v) for key, i, v in best[s]]
            rows += [("count", s, c, None, n, None, None) for c, n in enumerate(counts[ranges[s]: ranges[s + 1]].tolist())]
            rows.append(("cost", s, None, None, costs[s], None, None))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
        names = ("kind", "start", "cluster", "dim", "value", "indices", "weights")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        for s, total in sums.items():
            at = np.flatnonzero(total)
            none = [pa.nulls(len(at), t) for t in kinds[5:]]
            yield pa.RecordBatch.from_arrays([pa.array(["sum"] * len(at), pa.string()), pa.array(np.full(len(at), s), pa.int32()), pa.array(at // dims, pa.int32()), pa.array(at % dims, pa.int32()), pa.array(total[at]), *none], names)

    return run


def _choose(points: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """k of a few weighted points by k-means++, then some rounds among them; points repeat if there are fewer."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        far = ((points[:, None] - points[chosen][None]) ** 2).sum(2).min(1) * weights
        chosen.append(int(rng.choice(len(points), p=far / far.sum())) if far.sum() > 0 else chosen[0])
    centres = points[chosen].copy()
    for _ in range(10):
        label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            own = label == c
            if weights[own].sum() > 0:
                centres[c] = np.average(points[own], axis=0, weights=weights[own])
    return centres


def fit(vectors: DataFrame, indices: Column, values: Column, dims: int, k: int, seed: int, starts: int) -> tuple[np.ndarray, float]:
    """(centres, sum of squared distances) of the cheapest of ``starts`` seeded fits. ``vectors`` has a row at least."""
    context = importable(vectors.sparkSession).sparkContext
    rows = vectors.select(indices.alias("i"), values.alias("v"), F.xxhash64(indices, values).alias("h"))
    blocks = stage(rows.mapInArrow(_pack, _BLOCK), "vector-blocks")

    def run(kind: str, centres: list[np.ndarray], draw: int = 0, step: int = 0) -> DataFrame:
        return blocks.mapInArrow(_pass(kind, context.broadcast(centres), dims, draw, seed + 31 * step), _FOUND)

    def dense(row) -> np.ndarray:
        out = np.zeros(dims)
        out[np.frombuffer(row["indices"], np.int32)] = np.frombuffer(row["weights"])
        return out

    drawn = [np.zeros((0, dims))] * starts
    for step in range(STEPS + 1):
        draw = 2 * k if step else 1
        first = Window.partitionBy("start").orderBy("value", "indices", "weights")
        found = run("draw", drawn, draw, step).where("kind = 'drawn'").withColumn("n", F.row_number().over(first)).where(F.col("n") <= draw)
        more = sorted(found.collect(), key=lambda r: (r["start"], r["n"]))
        drawn = [np.concatenate([own, *[dense(r)[None] for r in more if r["start"] == s]]) for s, own in enumerate(drawn)]
    drawn = [d if len(d) else np.zeros((1, dims)) for d in drawn]

    weights = [np.zeros(len(d)) for d in drawn]
    for r in run("weigh", drawn).where("kind = 'count'").groupBy("start", "cluster").agg(F.sum("value").alias("n")).collect():
        weights[r["start"]][r["cluster"]] = r["n"]
    centres = [_choose(d, w, k, np.random.default_rng(seed + s)) for s, (d, w) in enumerate(zip(drawn, weights))]

    active = list(range(starts))
    for _ in range(ROUNDS):
        sums, counts = np.zeros((len(active), k, dims)), np.zeros((len(active), k))
        found = run("assign", [centres[s] for s in active]).where("kind <> 'cost'")
        table = found.groupBy("start", "cluster", F.coalesce("dim", F.lit(-1)).alias("dim")).agg(F.sum("value").alias("value")).toArrow()
        start, cluster, dim, value = (table.column(c).to_numpy() for c in ("start", "cluster", "dim", "value"))
        counts[start[dim < 0], cluster[dim < 0]] = value[dim < 0]
        sums[start[dim >= 0], cluster[dim >= 0], dim[dim >= 0]] = value[dim >= 0]
        moved = []
        for n, s in enumerate(active):
            # Rounded, so that the order in which tasks are summed up makes no difference.
            after = np.where(counts[n][:, None] > 0, np.round(sums[n] / np.maximum(counts[n], 1)[:, None], 12), centres[s])
            if ((after - centres[s]) ** 2).sum(1).max() > TOLERANCE ** 2:
                moved.append(s)
            centres[s] = after
        active = moved
        if not active:
            break
    costs = {r["start"]: r["cost"] for r in run("weigh", centres).where("kind = 'cost'").groupBy("start").agg(F.sum("value").alias("cost")).collect()}
    best = min(costs, key=lambda s: (round(costs[s], 9), s))
    return centres[best], costs[best]


def nearest(entries: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre of a sparse vector given as array<struct<i, v>>: the largest x.c - |c|^2 / 2, ties to the smaller number."""
    weights = constant(centres.T.tolist(), "array<array<double>>")
    begin = constant((-(centres * centres).sum(1) / 2).tolist(), "array<double>")
    scores = F.aggregate(entries, begin, lambda total, e: F.zip_with(total, F.get(weights, e["i"]), lambda t, w: t + e["v"] * w))
    return F.transform(F.array(scores), lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))[0]
