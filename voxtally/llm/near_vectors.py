"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors decide which pairs need exact cosines.

Each vector of length 1 is rotated at random, twice and independently, into at least CODE_BITS dimensions. The signs of the rotated components
are its two codes; the inner product of a code with its rotated vector is that code's correction. Both are computed once and stored, as bits. A code rotated
back and divided by its correction is the vector plus an error of known length whose direction is random among those at a right
angle to the vector. So the inner product of one vector's first code with another's second one is an unbiased estimate of their cosine, and a pair whose
estimate stays EPSILON standard deviations below the threshold is done. Only codes are copied to the pairs of blocks; the vectors that are in a
pair left open are fetched by a join, for exact cosines in double precision.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.components import components
from voxtally.llm.tables import store

THRESHOLD = 0.93
#: Standard deviations that a bound leaves: one pair in about 10 ** 9 may be missed.
EPSILON = 6.0
#: Bits of a code, at least (vectors with more components get as many bits as components, in whole bytes).
CODE_BITS = 256
#: Distinct vectors of a block. Blocks are compared in pairs, inside one label.
BLOCK = 2_048
#: Pairs whose bounds or cosines are held at a time.
_HELD = 1 << 20
_CODES = "first binary, second binary, first_correction float, second_correction float"


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int) -> np.ndarray:
    """``dims`` rows of a random orthogonal matrix with a column for each bit of a code."""
    bits = max(CODE_BITS, -(-dims // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng((seed, dims)).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dims])


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that no square leaves the range of a double."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes as packed bits, correction of each)."""
    rotated = unit @ rotation(unit.shape[1], seed)
    return np.packbits(rotated >= 0, axis=1), (np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])).astype(np.float32)


def decode(codes: np.ndarray, correction: np.ndarray, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimates of the vectors, squared lengths of their errors)."""
    back = rotation(dims, seed).astype(np.float32)
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    about = signs @ back.T / (np.sqrt(np.float32(back.shape[1])) * correction)[:, None]
    return about, np.maximum(0, np.einsum("ij,ij->i", about, about) - 1)


def lower_limits(left: np.ndarray, right: np.ndarray, dims: int, threshold: float, epsilon: float = EPSILON) -> np.ndarray:
    """The smallest estimate that a pair at or above the threshold is likely to have, by the squared lengths of both errors.

    An error is at a right angle to its vector, so only the sine of the angle between the vectors carries over; the third term is that of error with error.
    """
    sine2 = 1 - min(1.0, threshold) ** 2 if threshold > 0 else 1.0
    variance = ((left[:, None] + right[None, :]) * np.float32(sine2) + left[:, None] * right[None, :]) / np.float32(max(1, dims - 1))
    return np.float32(threshold - 1e-5) - np.float32(epsilon) * np.sqrt(variance)


class Codes:
    """The decoded codes of the vectors of a table."""

    def __init__(self, table: pa.Table, dims: int):
        self.dims = dims
        self.sides = []
        for seed, name in enumerate(("first", "second")):
            bits = np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(table.num_rows, -1)
            self.sides.append(decode(bits, table.column(f"{name}_correction").to_numpy(), dims, seed))

    def likely(self, rows: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs of rows and others may reach the threshold: both estimates, each with one vector's first and the other's second code, must allow it."""
        (first, first_error), (second, second_error) = self.sides
        open_ = first[rows] @ second[others].T >= lower_limits(first_error[rows], second_error[others], self.dims, threshold)
        if open_.any():
            open_ &= second[rows] @ first[others].T >= lower_limits(second_error[rows], first_error[others], self.dims, threshold)
        return open_


def _open_pairs(table: pa.Table, threshold: float):
    """``rows, others, which pairs of them are open`` for parts of all pairs of a pair of blocks."""
    block = table.column("block").to_numpy()
    codes = Codes(table, table.column("dims")[0].as_py())
    across = block.min() != block.max()
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block != block.min()) if across else left
    step = max(1, _HELD // len(right))
    for begin in range(0, len(left), step):
        rows = left[begin: begin + step]
        likely = codes.likely(rows, right, threshold)
        if not across:
            likely &= right[None, :] > rows[:, None]
        if likely.any():
            yield rows, right, likely


def _encoded(batches):
    for batch in batches:
        vectors, dims = batch.column("vector"), batch.column("dims").to_numpy()
        flat, offsets = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
        out = [[None] * len(dims) for _ in range(4)]
        for size in np.unique(dims):  # vectors of one length at a time
            rows = np.flatnonzero(dims == size)
            unit = normalised(flat[offsets[rows][:, None] + np.arange(size)])
            for seed in (0, 1):
                codes, correction = encode(unit, seed)
                for row, code, c in zip(rows.tolist(), codes, correction.tolist()):
                    out[seed][row], out[2 + seed][row] = code.tobytes(), c
        types = (pa.binary(), pa.binary(), pa.float32(), pa.float32())
        names = ("first", "second", "first_correction", "second_correction")
        yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names}, **{n: pa.array(o, t) for n, o, t in zip(names, out, types)}})


def _undecided(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """The vectors of a pair of blocks that are in a pair which the codes leave open."""
        wanted = np.zeros(table.num_rows, bool)
        for rows, others, likely in _open_pairs(table, threshold):
            wanted[rows] |= likely.any(axis=1)
            wanted[others] |= likely.any(axis=0)
        return table.filter(pa.array(wanted)).select(["home", "p", "q", "block", "node"])

    return run


def _links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Counts of links for each vector of a pair of blocks, and links that span what is connected."""
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        flat = table.column("vector").combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        unit = normalised(flat.flatten().to_numpy().reshape(len(node), -1))
        found = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        spanning = []
        for rows, others, likely in _open_pairs(table, threshold):
            i, j = np.nonzero(likely)
            i, j = rows[i], others[j]
            if len(i) > 0.2 * likely.size:  # a dense part: all its exact cosines at once
                cosine = (unit[rows] @ unit[others].T)[likely]
            else:
                cosine = np.concatenate([np.einsum("ij,ij->i", unit[i[k: k + 65_536]], unit[j[k: k + 65_536]]) for k in range(0, len(i), 65_536)])
            ok = cosine >= threshold
            i, j = i[ok], j[ok]
            np.add.at(found, i, copies[j])
            np.add.at(found, j, copies[i])
            for a, b in zip(i[label[i] != label[j]].tolist(), j[label[i] != label[j]].tolist()):
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    spanning.append((node[a], node[b]))
        some = np.flatnonzero(found)
        a = np.concatenate([node[some], np.array([x[0] for x in spanning], np.int64)])
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array([x[1] for x in spanning], pa.int64())])
        n = np.concatenate([found[some], np.zeros(len(spanning), np.int64)])
        return pa.table({"a": pa.array(a), "b": b, "n": pa.array(n)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Two vectors of one label link when their cosine, in double precision, reaches ``threshold``. Equal vectors are compared once and count with
    their copies, so a vector with very many copies is one vector here. Vectors of one label but other lengths never link. A vector that is null, empty, zero or
    holds null or non-finite components, or has no label, links with nothing and is its own component. Repeated rows are vectors of
    their own; a null id is nobody's smallest id unless it is alone. Other columns are ignored.
    """
    exact = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", exact.alias("v"))
    # 0 and -0 are equal: adding 0 makes them so.
    group = F.when(F.coalesce(fine, F.lit(False)), F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")))
    rows = rows.select("vec_id", group.alias("g"))
    distinct = rows.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    distinct = distinct.select("g.label", F.col("g.v").alias("vector"), F.size("g.v").alias("dims"), "copies", "least", F.monotonically_increasing_id().alias("node"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema)
    distinct = store(distinct.mapInArrow(_encoded, f"{fields}, {_CODES}"), "vectors")

    # A label's vectors of one length are cut into blocks of about BLOCK; each code goes to all pairs that its block is in.
    part = ["label", "dims"]
    sizes = distinct.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("node").alias("home"))
    codes = ["node", "first", "second", "first_correction", "second_correction"]
    placed = distinct.select(*part, *codes).join(sizes, part).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = placed.select("home", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "dims", *codes)
    undecided = store(pair.groupBy("home", "p", "q").applyInArrow(_undecided(threshold), "home long, p int, q int, block int, node long"), "vectors-undecided")
    fetched = undecided.join(distinct.select("dims", "vector", "copies", *codes), "node")
    found = store(fetched.groupBy("home", "p", "q").applyInArrow(_links(threshold), "a long, b long, n long"), "vector-links")

    more = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b"), "a", "b")
    known = store(distinct.join(more, "node", "left").join(groups, "node", "left").select(
        F.struct("label", F.col("vector").alias("v")).alias("g"), "least", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "vector-groups")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = known.join(smallest, "component").select("g", "n_links", "component_id")
    out = rows.join(answer, "g", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
