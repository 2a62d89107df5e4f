"""Quality: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates, scored as sparse dot products.

The n-grams are taken over two streams: the words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) and their shapes (which kinds of bytes a word holds, how
long it is, whether it repeats the word before). All n-grams of a text are hashed into one space, each with the weight of one n-gram in
the number of n-grams, so long and short texts compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxtally.llm.flat import LOWER, expand, mix, slices, span_hashes, text_bytes, with_text, word_spans
from voxtally.llm.tables import fold, with_kept

#: Labelled documents that are learned from, for each label value (expected number of a hash sample).
SAMPLE = 6_000
#: The sample is learned in so many shares at once, whose weights are averaged.
SHARES, EPOCHS = 8, 4
BITS, WORD_GRAMS, SHAPE_GRAMS = 18, 2, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
#: One n-gram's weight is SCALE / number of n-grams.
SCALE = 20.0

# Kinds of bytes: lower case, upper case, digit, sentence marks, other ASCII, beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[33:128], _KIND[128:] = 16, 32
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 4
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 8


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, where each text's begin plus the end)."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    words = span_hashes(LOWER[data], starts, ends)
    length = ends - starts
    at = expand(starts, length)
    local = np.cumsum(length) - length
    shape = np.bitwise_or.reduceat(_KIND[data[at]], local).astype(np.uint64)
    ends_with = _KIND[data[ends - 1]].astype(np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    size = np.minimum(length.astype(np.uint64) // np.uint64(6), np.uint64(7))
    shape = mix(shape | ends_with << np.uint64(6) | again << np.uint64(13) | size << np.uint64(14))
    parts, owners = [], []
    for stream, orders in ((words, WORD_GRAMS), (shape, SHAPE_GRAMS)):
        h = np.full(len(stream), 0x5851F42D4C957F2D if stream is words else 0x14057B7EF767814F, np.uint64)
        for n in range(orders):
            count = len(stream) - n
            if count <= 0:
                break
            h = mix((h[:count] ^ stream[n:]) + np.uint64(n + 1))
            ok = text[n:] == text[:count]
            parts.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(text[:count][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(first)))


def _learn(batches: list[pa.RecordBatch], epochs: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal, one document at a time, in the given order."""
    rows = []
    for whole in batches:
        for batch in slices(whole):
            found, begins = features(batch)
            for i, y in enumerate(batch.column("y").to_pylist()):
                at, n = np.unique(found[begins[i]: begins[i + 1]], return_counts=True)
                rows.append((np.append(at, 1 << BITS), np.append(n * (SCALE / max(1, n.sum())), 1.0), float(y)))
    z, n2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n2[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / ALPHA * w
            n2[at] += g * g
    every = weights(np.arange((1 << BITS) + 1))
    return every[:-1].astype(np.float32), float(every[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from ``labels`` (``doc_id`` and ``label``; the caller leaves held-out rows out).

    Learned from is a hash sample of about SAMPLE documents of each label value, equal texts once, in SHARES parts that are learned
    side by side; the driver gets SHARES weight vectors of a fixed size and averages them. Without labels all weights are zero.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(np.zeros(1 << BITS, np.float32), 0.0)
    if not sizes:
        return model
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE / n)))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    once = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.first("text").alias("text"))
    sample = once.withColumn("share", F.pmod(F.xxhash64("h"), F.lit(SHARES)).cast("int")).select("share", "h", "y", "text")

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("h").combine_chunks()
        w, b = _learn(ordered.to_batches(), EPOCHS)
        return pa.table({"rows": pa.array([table.num_rows]), "weights": pa.array([w.tobytes()]), "bias": pa.array([b])})

    learned = sample.groupBy("share").applyInArrow(learn, "rows long, weights binary, bias double").collect()
    total = sum(r["rows"] for r in learned)
    for r in learned:
        model.weights += np.frombuffer(r["weights"], np.float32) * np.float32(r["rows"] / total)
        model.bias += r["bias"] * r["rows"] / total
    return model


def score(docs: DataFrame, model: Model, kept: Column) -> DataFrame:
    """``kept`` (a struct of any columns), ``score`` (0 to 1), ``predicted`` (1 from 0.5 on). A null or empty text has the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = with_kept(docs, kept)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(with_text(whole)):
                found, begins = features(batch)
                n = np.diff(begins)
                dot = np.zeros(batch.num_rows)
                full = np.flatnonzero(n)
                if len(full):
                    dot[full] = np.add.reduceat(m.weights[found], begins[:-1][full], dtype=np.float64) * SCALE / n[full]
                p = 1 / (1 + np.exp(-np.clip(dot + m.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(p)], ["kept", "score"])

    rated = given.mapInArrow(rate, StructType([given.schema["kept"], StructField("score", DoubleType())]))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels of held-out ids take no part in the learning."""
    model = train(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, model, F.struct("doc_id", (fold("doc_id", 3) == 1).alias("held_out"))).select("kept.*", "score", "predicted")
