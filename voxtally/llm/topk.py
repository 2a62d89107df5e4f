"""Exact top-k inner products by a three-phase uniform threshold.

The components are dealt to a few slices; a slice of a block of candidates is a node that knows partial scores only. Phase 1: each node sends its local list,
the k best partial scores of each query, and the listed candidates are resolved; the k-th best score is a cutoff no result lies below. Phase 2:
the cutoff goes to the nodes, and each sends the entries with at least cutoff / slices: a candidate that no node sends has a smaller sum. Phase 3: the scores
of what was sent are completed exactly, and the best k of each query are ranked.

Queries and candidates meet as blocks; no task ever holds more than one pair of blocks, and no pair of rows is emitted unless a node lists it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxtally.llm.tables import store

SLICES = 2
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4_096
_KEY = ["length", "qb", "cb"]
#: Stands for a score below all longs.
TOO_SMALL = -(1 << 63)


def _as_block(slices: int):
    def run(table: pa.Table) -> pa.Table:
        """The rows of a block as one matrix for each slice, in the order of their ids."""
        table = table.sort_by([("id", "ascending"), ("uid", "ascending")])
        matrix = np.array(table.column("v").to_pylist(), np.int64)
        widest = int(max(matrix.max(), -1 - matrix.min())) if matrix.size else 0
        matrix = matrix.astype(np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.int64)
        parts = np.array_split(matrix, slices, axis=1)
        ids, cutoffs = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "cutoff"))
        n = len(parts)
        return pa.table({
            "length": pa.array([matrix.shape[1]] * n, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * n, pa.int32()), "slice": pa.array(range(n), pa.int32()),
            "ids": pa.array([ids] * n, pa.binary()), "cutoffs": pa.array([cutoffs] * n, pa.binary()), "matrix": pa.array([bytes([p.itemsize]) + p.tobytes() for p in parts], pa.binary())})

    return run


def _blocks(rows: DataFrame, slices: int, size: int, count: int) -> DataFrame:
    block = F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-count // size)))).cast("int")
    given = rows.withColumn("length", F.size("v")).withColumn("block", block)
    return given.groupBy("length", "block").applyInArrow(_as_block(slices), "length int, block int, slice int, ids binary, cutoffs binary, matrix binary")


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["cutoffs"], np.int64), np.frombuffer(row["matrix"], f"i{row['matrix'][0]}", offset=1).reshape(len(ids), -1).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(all inner products modulo 2 ** 64 as longs, where they may not fit a long; None: all fit).

    In doubles while every sum stays below 2 ** 53. Integer products and sums that wrap around still give the right long wherever the true value is one.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64), None
    largest = int(np.abs(a.astype(float)).max()) * int(np.abs(b.astype(float)).max()) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64), None
    product = a @ b.T
    if largest < 1 << 62:
        return product, None
    return product, _unsure(a.astype(float) @ b.T.astype(float), np.abs(a.astype(float)) @ np.abs(b.T.astype(float)))


def _unsure(value: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """Where a sum in doubles (``size``: that of its absolute terms, which bounds the rounding) may not fit a long."""
    found = np.abs(value) + 1e-12 * size >= 2.0 ** 63
    return found if found.any() else None


def _lists(k: int, slices: int, cut: bool):
    """What a node sends: its k best entries of each query, or those that reach the cutoff."""

    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        qi, ci, partial = [], [], []
        if queries.num_rows and candidates.num_rows:
            qids, cutoffs, q = _matrix(queries.to_pylist()[0])
            cids, _, c = _matrix(candidates.to_pylist()[0])
            score, unsure = _products(q, c)
            own = qids[:, None] == cids[None, :]
            if cut:
                reach = score >= (cutoffs // slices + (cutoffs % slices != 0))[:, None]
                qi, ci = np.nonzero((reach if unsure is None else reach | unsure) & ~own)  # a share that may have wrapped around is sent in any case
            else:
                few = min(k, len(cids))
                best = np.argpartition(np.where(own, np.iinfo(np.int64).min, score), len(cids) - few, axis=1)[:, len(cids) - few:]
                qi, ci = np.repeat(np.arange(len(qids)), few), best.ravel()
                qi, ci = qi[~own[qi, ci]], ci[~own[qi, ci]]
            partial = score[qi, ci]
        length, _, qb, cb = (x.as_py() for x in key)
        packed = [np.asarray(x, t).tobytes() for x, t in ((qi, np.int32), (ci, np.int32), (partial, np.int64))]
        return pa.table({
            "length": pa.array([length], pa.int32()), "qb": pa.array([qb], pa.int32()), "cb": pa.array([cb], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()),
            **{n: pa.array([x], pa.binary()) for n, x in zip(("qi", "ci", "partial"), packed)}})

    return run


def _resolve(k: int, slices: int, cut: bool):
    """Complete the scores of the entries sent for a pair of blocks, and keep the best k of each query."""

    def run(key: tuple, entries: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        sides = [{r["slice"]: _matrix(r) for r in rows if r["asks"] == asks} for asks in (True, False)]
        none = np.zeros(0, np.int64)
        if not (sides[0] and sides[1]) or not entries.num_rows:
            return pa.table({n: pa.array(none) for n in ("query_id", "vec_id", "score")})
        qids, cutoffs, _ = sides[0][0]
        cids = sides[1][0][0]
        width = len(cids)
        sent = {r["slice"]: (np.frombuffer(r["qi"], np.int32).astype(np.int64) * width + np.frombuffer(r["ci"], np.int32), np.frombuffer(r["partial"], np.int64)) for r in entries.to_pylist()}
        pairs = np.unique(np.concatenate([x[0] for x in sent.values()]))
        q, c = pairs // width, pairs % width
        score = np.zeros(len(pairs), np.int64)
        for s in range(slices):
            have, partial = sent.get(s, (none, none))
            at = np.searchsorted(pairs, have)
            score[at] += partial
            missing = np.ones(len(pairs), bool)
            missing[at] = False
            a, b = sides[0][s][2], sides[1][s][2]
            where = np.flatnonzero(missing)
            if len(where) > 0.02 * len(qids) * width:  # many: the whole product is cheaper than single ones
                score[where] += _products(a, b)[0][q[where], c[where]]
            else:
                for i in range(0, len(where), 100_000):
                    w = where[i: i + 100_000]
                    score[w] += np.einsum("ij,ij->i", a[q[w]], b[c[w]])
        _correct(score, [x[2][q] for x in sides[0].values()], [x[2][c] for x in sides[1].values()])
        if cut:
            ok = score >= cutoffs[q]
            q, c, score = q[ok], c[ok], score[ok]
        order = np.lexsort((cids[c], ~score, q))  # ~ turns the order around without overflow
        q, c, score = q[order], c[order], score[order]
        first = np.searchsorted(q, np.arange(len(qids)))
        ok = np.arange(len(q)) - first[q] < k
        return pa.table({"query_id": pa.array(qids[q[ok]]), "vec_id": pa.array(cids[c[ok]]), "score": pa.array(score[ok])})

    return run


def _correct(score: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> None:
    """Look at the scores of single pairs that may not fit a long with Python's integers. One that is too large is a result, and so an error; one
    that is too small becomes ``TOO_SMALL``, an error only if it is among the best."""
    if sum(a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) for a, b in zip(left, right)) < 2.0 ** 62:
        return
    value, size = (sum(np.einsum("ij,ij->i", f(a.astype(float)), f(b.astype(float))) for a, b in zip(left, right)) for f in (np.asarray, np.abs))
    unsure = _unsure(value, size)
    for i in [] if unsure is None else np.flatnonzero(unsure).tolist():
        true = sum(int(x) * int(y) for a, b in zip(left, right) for x, y in zip(a[i], b[i]))
        if true >= 1 << 63:
            raise OverflowError("a score does not fit a long")
        score[i] = max(true, TOO_SMALL)


def _best(resolved: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return resolved.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, slices: int = SLICES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products, ties to the smaller id; all, if there are fewer.

    Both tables hold ``id`` and an array ``v`` of longs. A query does not meet candidates of its own id, or vectors of another length. A query
    id that repeats is asked once (with its smallest vector); a candidate that repeats counts each time. Null ids, null or empty arrays take no part.
    A score among the best that does not fit a long is an error.
    """
    clean = [t.where(F.col("id").isNotNull() & (F.size("v") > 0)).select("id", "v") for t in (queries.groupBy("id").agg(F.min("v").alias("v")), candidates)]
    asking, held = (store(t.withColumn("uid", F.monotonically_increasing_id()), "top-k-rows") for t in clean)
    asked, offered = asking.count(), held.count()
    nothing = F.lit(TOO_SMALL).cast("long")
    cb = store(_blocks(held.withColumn("cutoff", nothing), slices, CANDIDATE_BLOCK, offered), "candidate-blocks")
    query_blocks, candidate_blocks = (max(1, -(-n // size)) for n, size in ((asked, QUERY_BLOCK), (offered, CANDIDATE_BLOCK)))
    each_c = cb.withColumn("cb", F.col("block")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).drop("block")

    def ask(cutoffs: DataFrame, cut: bool) -> DataFrame:
        qb = store(_blocks(cutoffs, slices, QUERY_BLOCK, asked), "query-blocks")
        each_q = qb.withColumn("qb", F.col("block")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1)))).drop("block")
        node = ["length", "slice", "qb", "cb"]
        lists = each_q.groupBy(*node).cogroup(each_c.groupBy(*node)).applyInArrow(_lists(k, slices, cut), "length int, qb int, cb int, slice int, qi binary, ci binary, partial binary")
        both = each_q.withColumn("asks", F.lit(True)).unionByName(each_c.withColumn("asks", F.lit(False)))
        resolved = lists.groupBy(*_KEY).cogroup(both.groupBy(*_KEY)).applyInArrow(_resolve(k, slices, cut), "query_id long, vec_id long, score long")
        return _best(resolved, k)

    listed = ask(asking.withColumn("cutoff", nothing), False).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
    cutoffs = asking.join(listed, "id", "left").select("id", "v", "uid", F.coalesce("reached", nothing).alias("cutoff"))
    score = F.when(F.col("score") == TOO_SMALL, F.raise_error(F.lit("a score does not fit a long"))).otherwise(F.col("score"))
    return ask(cutoffs, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``id, v``: floor(scale * x) of each component as a long; vectors that are null or hold null or non-finite components are left out."""
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
