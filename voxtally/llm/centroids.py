"""Centroid clustering by Lloyd rounds with ns-bounds: few distances are evaluated, every result is exact.

Each vector keeps, for every centroid, the distance at its last evaluation and the round of it. All centroids of all rounds are kept as well. A
centroid that has since moved by a total displacement p can't be nearer than the stored distance - p, nor farther than the distance + p. The norm of
the total displacement is at most the sum of the drifts of the single rounds, and is zero again for a centroid that came back. Where these
bounds leave a doubt, the own centroid is evaluated first, then those that could still be as near: exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.tables import drop, store

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64.0
#: Relative room left for rounding in the stored distances (kept as 32-bit floats) and in the displacements.
SLACK = 1e-6
_STATE = "uid long, vec_id long, v binary, cluster int, near binary, seen binary, distance long, evaluations int, dim int, total decimal(38,0)"


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances: in doubles below 2 ** 53, in 64-bit integers below 2 ** 63, else in Python's integers."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    widest = len(centroid) * (int(np.abs(vectors).max()) + max(abs(int(x)) for x in centroid)) ** 2
    kind = float if widest < 1 << 53 else np.int64 if widest < 1 << 63 else object
    apart = vectors.astype(kind) - np.array(centroid, kind)
    found = (apart * apart).sum(1) if kind is object else np.einsum("ij,ij->i", apart, apart)
    return found if kind is object else found.astype(np.int64)


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 32-bit integers, or 64-bit ones where they are needed."""
    found = np.floor(values * scale)
    if len(found) and np.abs(found).max() >= 2.0 ** 62:
        raise OverflowError("a component times the scale does not fit a long")
    return found.astype(np.int32 if not len(found) or np.abs(found).max() < 2.0 ** 31 else np.int64)


def _quantised(dims: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = quantise(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims), scale)
            yield pa.record_batch({"uid": batch.column("uid"), "vec_id": batch.column("vec_id"), "v": pa.array([x.tobytes() for x in values], pa.binary())})

    return run


def quantised(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """``uid, vec_id, v``: the vectors with exactly ``dims`` components, none null or non-finite, as packed integers floor(scale * x)."""
    fine = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rows.mapInArrow(_quantised(dims, scale), "uid long, vec_id long, v binary")


def unpack(column: pa.Array, dims: int) -> np.ndarray:
    """Packed vectors as one matrix; rows may differ in width."""
    raw = column.to_pylist()
    if len({len(x) for x in raw}) == 1:
        return np.frombuffer(b"".join(raw), np.int32 if len(raw[0]) == 4 * dims else np.int64).reshape(len(raw), dims).astype(np.int64)
    return np.array([np.frombuffer(x, np.int32 if len(x) == 4 * dims else np.int64) for x in raw], np.int64).reshape(len(raw), dims)


def first_centroids(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ones by id, then by row; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    best = rows.orderBy(order.asc_nulls_last(), "vec_id", "uid").select("v").limit(k).toArrow()
    return unpack(best.column("v"), dims) if best.num_rows else np.zeros((0, dims), np.int64)


def reassign(vectors: np.ndarray, cluster: np.ndarray, near: np.ndarray, seen: np.ndarray, history: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance to it where it was evaluated now, else -1, number of evaluations) in round len(history) - 1.

    ``near`` and ``seen`` (distance and round of the last evaluation of each centroid) are brought up to date. Ties go to the smaller number:
    a centroid is left out only if it is certainly farther. ``exact`` evaluates the own centroid in any case.
    """
    now, count, rows = len(history) - 1, history.shape[1], np.arange(len(vectors))
    distance = np.full((len(vectors), count), -1, object if len(vectors) and squared(vectors[:1], history[now][0]).dtype == object else np.int64)
    evaluated = np.zeros(len(vectors), np.int32)

    def evaluate(at: np.ndarray, j: int) -> None:
        found = squared(vectors[at], history[now][j])
        if found.dtype == object and distance.dtype != object:
            raise OverflowError("distances do not fit a long")
        distance[at, j] = found
        near[at, j] = np.sqrt(found.astype(float))
        seen[at, j] = now
        evaluated[at] += 1

    if now == 0:
        for j in range(count):
            evaluate(rows, j)
    else:
        apart = history[:now + 1].astype(float) - history[now].astype(float)
        moved = np.sqrt((apart * apart).sum(2)) * (1 + SLACK)  # by round and centroid
        low = near * (1 - SLACK) - moved[seen, np.arange(count)]

        def doubtful(at: np.ndarray) -> np.ndarray:
            own = cluster[at]
            up = near[at, own] * (1 + SLACK) + moved[seen[at, own], own]
            open_ = low[at] <= up[:, None]
            open_[np.arange(len(at)), own] = False
            return open_

        doubt = rows if exact else rows[doubtful(rows).any(1)]
        for j in range(count):
            evaluate(doubt[cluster[doubt] == j], j)
        open_ = doubtful(doubt)
        for j in range(count):
            evaluate(doubt[open_[:, j]], j)
    some = np.flatnonzero(evaluated)
    known = distance[some]
    known[known < 0] = np.iinfo(np.int64).max if known.dtype != object else 1 << 200
    result, best = cluster.copy(), np.full(len(vectors), -1, distance.dtype)
    result[some] = known.argmin(1)
    best[some] = known[np.arange(len(some)), result[some]]
    return result, best, evaluated


def _round(shared, dims: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors with their new state, and at the end what the sums of each cluster change by in this task (dim -1: the rows)."""
        history = shared.value
        count = history.shape[1]
        totals = np.zeros((count, dims + 1), object)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = unpack(batch.column("v"), dims)
            if "near" in batch.schema.names:
                before = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float32).reshape(n, count).copy()
                seen = np.frombuffer(b"".join(batch.column("seen").to_pylist()), np.uint8).reshape(n, count).copy()
                so_far = batch.column("evaluations").to_numpy(zero_copy_only=False)
            else:
                before, near, seen, so_far = np.full(n, -1), np.zeros((n, count), np.float32), np.zeros((n, count), np.uint8), 0
            cluster, distance, evaluated = reassign(vectors, before, near, seen, history, last)
            changed = cluster != before
            for j in range(count):
                for rows, sign in ((changed & (cluster == j), 1), (changed & (before == j), -1)):
                    if rows.any():
                        own = vectors[rows]
                        wide = int(np.abs(own).max()) * len(own) >= 1 << 62
                        totals[j, :dims] += sign * (own.astype(object) if wide else own).sum(0).astype(object)
                        totals[j, dims] += sign * int(rows.sum())
            if last and len(distance) and max(distance.tolist()) >= 1 << 63:
                raise OverflowError("a squared distance does not fit a long")
            nulls = pa.nulls(n, pa.int32())
            yield pa.record_batch({
                "uid": batch.column("uid"), "vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": pa.array(cluster.astype(np.int32)),
                "near": pa.array([x.tobytes() for x in near], pa.binary()), "seen": pa.array([x.tobytes() for x in seen], pa.binary()),
                "distance": pa.array(distance.tolist() if last else [None] * n, pa.int64()), "evaluations": pa.array((so_far + evaluated).astype(np.int32)), "dim": nulls, "total": pa.nulls(n, pa.decimal128(38, 0))})
        j, dim = np.nonzero(totals)
        none = pa.nulls(len(j), pa.int64())
        packed = pa.nulls(len(j), pa.binary())
        yield pa.record_batch({
            "uid": none, "vec_id": none, "v": packed, "cluster": pa.array(j.astype(np.int32)), "near": packed, "seen": packed, "distance": none,
            "evaluations": pa.nulls(len(j), pa.int32()), "dim": pa.array(dim.astype(np.int32)), "total": pa.array([Decimal(int(x)) for x in totals[j, dim]], pa.decimal128(38, 0))})

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance, evaluations`` for each vector that takes part, the final centroids as integers).

    Vectors are ``vec_id, embedding``; those with other than ``dims`` components, or with null or non-finite ones, are left out. Components become
    floor(scale * x). Each round assigns every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces
    each centroid that has vectors by the componentwise floor of their mean; one more assignment follows. With fewer than ``k`` vectors there are as many centroids as
    vectors. Repeated rows count each time; null ids take part and come last as first centroids; an empty table gives no rows; other columns are
    ignored. A squared distance that does not fit a long is an error. ``evaluations`` tells how many distances were computed for the vector.

    What reaches the driver are sums for each centroid and component, and all centroids of all rounds (``k * dims * (rounds + 1)`` numbers) are broadcast.
    """
    if not 0 <= rounds < 255:
        raise ValueError("rounds must be under 255")
    spark = vectors.sparkSession
    state = store(quantised(vectors, dims, scale), "vectors-packed")
    centroids = first_centroids(state, k, seed, dims)
    if not len(centroids):
        return state.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"), F.lit(None).cast("int").alias("evaluations")).limit(0), centroids
    history, totals = centroids[None], np.zeros((len(centroids), dims + 1), object)
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(history)
        after = store(state.mapInArrow(_round(shared, dims, turn == rounds), _STATE), "vectors-assigned")
        drop(state)  # what came before is not read again
        state = after.where("v is not null").select("uid", "vec_id", "v", "cluster", "near", "seen", "distance", "evaluations")
        if turn == rounds:
            break
        for r in after.where("v is null").groupBy("cluster", "dim").agg(F.sum("total").alias("total")).toLocalIterator():
            totals[r["cluster"], r["dim"]] += int(r["total"])
        centroids = np.array([[s // own[dims] for s in own[:dims]] if own[dims] else list(before) for own, before in zip(totals, centroids.tolist())], np.int64)
        history = np.concatenate([history, centroids[None]])
    return state.select("vec_id", "cluster", "distance", "evaluations"), centroids


def summarised(vectors: DataFrame) -> DataFrame:
    """``cluster``'s result with the registered parameters, with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    The sums and digests of the centroids are a row each, so they can be broadcast.
    """
    import hashlib

    assigned, centroids = cluster(vectors)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum((int(r["s"]) for r in sums), 0)
    if total >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    rows = [(r["cluster"], int(r["s"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
