"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from voxtally.llm.flat import slices, text_bytes, with_text
from voxtally.llm.tables import fold, with_kept

#: Labelled rows that the counts are taken from, for each language at most (expected number of a hash sample).
SAMPLE_PER_LANG = 6_000
#: Languages in a column block of the matrix. Every learned language is scored, block by block; a worker holds 0.8 MB for each.
BLOCK_LANGS = 64
BITS, ORDERS = 16, (1, 2, 3)
#: Text bytes scored at once: each byte costs some 100 bytes of hashes and places, and a worker keeps its largest need.
SCORED_BYTES = 1 << 18
SMOOTHING = 0.5
UNKNOWN = "und"
#: What the pipeline asks of a document: a learned language, held likelier than this.
MIN_SCORE = 0.3

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


@dataclass
class Model:
    langs: list[str]
    log_prob: list[np.ndarray]  # (orders * buckets, languages) in blocks of languages
    prior: np.ndarray


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def grams(batch: pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the hashed n-grams and where each text's begin; which texts have a letter. Characters that are no letters count as one."""
    data, offsets = text_bytes(pc.utf8_lower(batch.column("text")))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    is_letter = letter_table()[points]
    seen = np.concatenate(([0], np.cumsum(is_letter)))
    chars = np.where(is_letter, points + 1, 0).astype(np.uint32)
    out = []
    for place, n in enumerate(ORDERS):
        count = max(0, len(chars) - n + 1)
        h = np.full(count, 0x27D4EB2F * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ chars[k: k + count]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        h = (h >> np.uint32(32 - BITS)).astype(np.int64) + (place << BITS)
        # n-grams lie inside one text and hold a letter
        owner_end = np.repeat(begins[1:], np.diff(begins))[:count]
        at = np.arange(count)
        ok = (at + n <= owner_end) & (seen[n: n + count] > seen[:count])
        out.append((h[ok], np.concatenate(([0], np.cumsum(ok)))[np.minimum(begins, count)]))
    return out, seen[begins[1:]] > seen[begins[:-1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(ORDERS) << BITS
    counts: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole):
            found, _ = grams(batch)
            langs = batch.column("lang").to_pylist()
            for h, begins in found:
                for lang in set(langs):
                    rows = [i for i, x in enumerate(langs) if x == lang]
                    own = np.concatenate([h[begins[i]: begins[i + 1]] for i in rows])
                    counts[lang] = counts.get(lang, np.zeros(size, np.int64)) + np.bincount(own, minlength=size)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def train(docs: DataFrame, usable: Column) -> Model:
    """Learn from the rows where ``usable`` holds: a hash sample of about ``SAMPLE_PER_LANG`` rows of each language.

    What reaches the driver is one count for each language and n-gram bucket, a size that doesn't depend on the rows.
    Without any labelled row the model knows no language, and every prediction is ``und``.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang"), F.col("text"), F.col("doc_id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    size = len(ORDERS) << BITS
    if not langs:
        return Model([], [], np.zeros(0))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE_PER_LANG / n) * (1 << 20)) for k, n in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share")
    sample = labelled.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text").repartition(12)
    rows = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((size, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    columns = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[rows.column("bucket").to_numpy(), columns] = rows.column("n").to_numpy()
    by_order = counts.reshape(len(ORDERS), 1 << BITS, len(langs)) + SMOOTHING
    totals = by_order.sum(1, keepdims=True)
    blocks = [np.log(by_order[:, :, a: a + BLOCK_LANGS] / totals[:, :, a: a + BLOCK_LANGS]).reshape(size, -1).astype(np.float32) for a in range(0, len(langs), BLOCK_LANGS)]
    prior = np.array([sizes[x] for x in langs], float)
    return Model(langs, blocks, np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, kept: Column) -> DataFrame:
    """``kept`` (a struct of any columns), ``lang_pred`` and ``score``: the likeliest learned language of the whole text, and its posterior.

    A null text, one without a letter, or a model without languages gives ``und`` with score 0. Ties go to the first language in
    alphabetical order. Only the text is looked at.
    """
    context = docs.sparkSession.sparkContext
    shared, matrix = context.broadcast((model.langs, model.prior)), [context.broadcast(x) for x in model.log_prob]
    given = with_kept(docs, kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior = shared.value
        names = np.array([*langs, UNKNOWN], object)
        for whole in batches:
            for batch in slices(with_text(whole), size=SCORED_BYTES):
                found, lettered = grams(batch)
                if not langs:
                    yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([UNKNOWN] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows))], ["kept", "lang_pred", "score"])
                    continue
                total = np.tile(prior, (batch.num_rows, 1))
                for h, begins in found:
                    full = np.flatnonzero(begins[1:] > begins[:-1])
                    for k, block in enumerate(matrix if len(full) else ()):
                        a = k * BLOCK_LANGS
                        total[full, a: a + BLOCK_LANGS] += np.add.reduceat(block.value[h], begins[:-1][full], axis=0, dtype=np.float64)
                top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                best = names[np.where(lettered, total.argmax(1), len(langs))]
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(best, pa.string()), pa.array(np.where(lettered, top, 0.0))], ["kept", "lang_pred", "score"])

    schema = StructType([given.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return given.mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document; what is held out takes no part in the learning."""
    held_out = fold("doc_id", 3) == 1
    return predict(docs, train(docs, ~held_out), F.struct("doc_id", held_out.alias("held_out"))).select("kept.*", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is one of the learned ones; all columns stay as they are."""
    marked = predict(docs, train(docs, fold("doc_id", 3) != 1), F.struct("*"))
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("kept.*")
