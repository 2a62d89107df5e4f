"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

The unit that the kernel compares is a word: its letters in lower case, everything else dropped, with single letters that stand in a row
joined ("i d i o t", "id1iot" and "i.d.i.o.t" are one unit). Its features are the ordered letter triples of a unit, framed by a
start and an end mark, weighted by DECAY for each letter skipped; SPAN bounds how far a triple reaches. Labels belong to whole documents, so
training is multiple-instance: a toxic document has at least one toxic unit (its witness, chosen anew in each round), a clean one has none.

With the machine linear in the Nystroem features, its weights fold back into one weight for each triple: a document's score costs a
few table reads a letter, and is exactly the machine's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxtally.llm.flat import expand, slices, span_hashes, text_bytes, with_text
from voxtally.llm.tables import fold, store, with_kept

#: Labelled documents that are learned from (expected number of a hash sample of each class).
TOXIC_SAMPLE, CLEAN_SAMPLE = 3_000, 5_000
#: Units of a toxic document that can be its witness; units of clean documents learned from; landmarks; rounds of witnesses.
WITNESSES, NEGATIVES, LANDMARKS, ROUNDS = 12, 4_000, 256, 4
DECAY, SPAN = 0.6, 5
#: Longer units are compared in overlapping pieces; shorter ones carry no triple worth comparing.
PIECE, STEP, SHORTEST = 24, 12, 3
# Symbols: 1 to 26 are a to z, 27 to 61 the other letters (by code point), then the marks of a unit's start and end.
_BITS, _OTHERS, _START, _END = 6, 35, 62, 63
_TRIPLES = 1 << 3 * _BITS
_GAPS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_tables: list[np.ndarray] = []


@dataclass
class Model:
    weights: np.ndarray  # one for each triple of symbols
    bias: float
    slope: float  # margin to probability
    offset: float


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Code point to symbol (0: no letter), and which are white space."""
    if not _tables:
        symbol = np.zeros(0x110000, np.uint8)
        space = np.zeros(0x110000, bool)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                symbol[c] = c - 96 if 97 <= c <= 122 else 27 + c % _OTHERS
            elif x.isspace():
                space[c] = True
        _tables.extend((symbol, space))
    return _tables[0], _tables[1]


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters as symbols, starts, lengths, text number) of the units of a batch, in order."""
    symbol, space = _symbols()
    data, offsets = text_bytes(pc.utf8_lower(batch.column("text")))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    none = np.zeros(0, np.int64)
    if not len(points):
        return np.zeros(0, np.uint8), none, none, none
    blank = space[points]
    first = ~blank
    first[1:] &= blank[:-1]
    at_doc = begins[begins < len(points)]
    first[at_doc] = ~blank[at_doc]
    word = np.cumsum(first) - 1
    s = symbol[points]
    where = np.flatnonzero(s)
    if not len(where):
        return np.zeros(0, np.uint8), none, none, none
    own = word[where]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    lengths = np.diff(np.append(starts, len(own)))
    number = own[starts]
    text = np.searchsorted(begins, where[starts], side="right") - 1
    single = lengths == 1
    joins = np.zeros(len(starts), bool)
    joins[1:] = single[1:] & single[:-1] & (number[1:] == number[:-1] + 1) & (text[1:] == text[:-1])
    starts, text = starts[~joins], text[~joins]
    lengths = np.diff(np.append(starts, len(own)))
    ok = lengths >= SHORTEST
    starts, lengths, text = starts[ok], lengths[ok], text[ok]
    long = lengths > PIECE
    if long.any():
        pieces = 1 + -(-(lengths[long] - PIECE) // STEP)
        inner = expand(np.zeros(len(pieces), np.int64), pieces) * STEP
        extra = np.repeat(starts[long], pieces) + inner
        rest = np.minimum(np.repeat(lengths[long], pieces) - inner, PIECE)
        starts, lengths, text = np.concatenate((starts[~long], extra)), np.concatenate((lengths[~long], rest)), np.concatenate((text[~long], np.repeat(text[long], pieces)))
        order = np.argsort(text, kind="stable")
        starts, lengths, text = starts[order], lengths[order], text[order]
    return s[where], starts, lengths, text


def _framed(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All units in one array, each between a start and an end mark; where each begins, and the end."""
    begins = np.concatenate(([0], np.cumsum(lengths + 2)))
    out = np.empty(begins[-1], np.int64)
    out[begins[:-1]] = _START
    out[begins[1:] - 1] = _END
    out[expand(begins[:-1] + 1, lengths)] = letters[expand(starts, lengths)]
    return out, begins


def _norm(lengths: np.ndarray) -> np.ndarray:
    """Grows with a unit's length only: the root of the squared weights of its triples."""
    total = np.zeros(len(lengths))
    for _, b in _GAPS:
        total += DECAY ** (2 * (b - 2)) * np.maximum(0, lengths + 2 - b)
    return np.sqrt(total)


def _triple(stream: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
    return (stream[at] << 2 * _BITS) | (stream[at + a] << _BITS) | stream[at + b]


def _project(table: np.ndarray, stream: np.ndarray, begins: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """For each unit the weighted sum of ``table`` over its triples, divided by its norm; ``row`` is where a triple's row stands."""
    total = np.zeros((len(stream), *table.shape[1:]), table.dtype)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for a, b in _GAPS:
        n = len(stream) - b
        if n <= 0:
            continue
        at = np.flatnonzero(owner[b:] == owner[:n])
        feature = _triple(stream, at, a, b)
        total[at] += table[feature if row is None else row[feature]] * table.dtype.type(DECAY ** (b - 2))
    out = np.add.reduceat(total, begins[:-1], axis=0)
    return out / _norm(np.diff(begins) - 2).astype(table.dtype).reshape(-1, *[1] * (table.ndim - 1))


def _encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    letters = np.frombuffer("".join(units).encode("latin-1"), np.uint8) - 64
    lengths = np.array([len(u) for u in units], np.int64)
    return _framed(letters, np.cumsum(lengths) - lengths, lengths)


def _vectors(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The feature vectors of a few units, one column each, over the triples that any of them has; row of each triple (0: none of them)."""
    stream, begins = _encode(units)
    owner = np.repeat(np.arange(len(units)), np.diff(begins))
    parts = []
    for a, b in _GAPS:
        n = max(0, len(stream) - b)
        at = np.flatnonzero(owner[b:] == owner[:n])
        parts.append((_triple(stream, at, a, b), owner[at], np.full(len(at), DECAY ** (b - 2))))
    triple, unit, weight = (np.concatenate(x) for x in zip(*parts))
    used = np.unique(triple)
    row = np.zeros(_TRIPLES, np.int32)
    row[used] = np.arange(1, len(used) + 1)
    out = np.zeros((len(used) + 1, len(units)), np.float32)
    np.add.at(out, (row[triple], unit), weight)
    return out / _norm(np.diff(begins) - 2).astype(np.float32), row


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps on the active rows; the last column of ``z`` is 1."""
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        active = y * (z @ w) < 1
        za = z[active] * cost[active, None]
        new = np.linalg.solve(za.T @ z[active] + np.diag(penalty), za.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _margins(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    """The largest margin of each text's units; the bias alone for a text without units."""
    letters, starts, lengths, text = _units(batch)
    out = np.full(batch.num_rows, model.bias)
    if len(starts):
        order = np.argsort(starts, kind="stable")
        apart = np.all(starts[order][1:] >= (starts + lengths)[order][:-1])
        if apart:  # equal units are compared once
            h = span_hashes(letters, starts, starts + lengths)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
        else:
            first, back = np.arange(len(starts)), np.arange(len(starts))
        margin = _project(model.weights, *_framed(letters, starts[first], lengths[first]))[back] + model.bias
        full, begin = np.unique(text, return_index=True)
        out[full] = np.maximum.reduceat(margin, begin)
    return out


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            letters, starts, lengths, text = _units(batch)
            said = (letters + 64).tobytes().decode("latin-1")
            pairs = sorted({(t, said[a: a + n]) for a, n, t in zip(starts.tolist(), lengths.tolist(), text.tolist())})
            at = np.array([t for t, _ in pairs], np.int64)
            yield pa.record_batch({"bag": batch.column("bag").take(pa.array(at)), "toxic": batch.column("toxic").take(pa.array(at)), "unit": pa.array([u for _, u in pairs], pa.string())})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn from ``labels`` (``doc_id`` and ``label``; the caller leaves held-out rows out).

    Learned from is a hash sample of about TOXIC_SAMPLE and CLEAN_SAMPLE documents, equal texts once. To the driver come at most
    WITNESSES units of each sampled toxic document and NEGATIVES units of the clean ones. Without labels of both kinds every score
    is the share of toxic labels (0 without any).
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(_TRIPLES, np.float32), -1.0, 0.0, 30.0 if sizes.get(1) else -30.0)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, TOXIC_SAMPLE / sizes[1]))).otherwise(F.lit(min(1.0, CLEAN_SAMPLE / sizes[0])))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    once = texts.withColumn("bag", F.xxhash64("text")).groupBy("bag").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = store(once, "toxicity-sample")
    rows = store(sample.select("bag", "toxic", "text").repartition(12).mapInArrow(_unit_rows, "bag long, toxic int, unit string"), "toxicity-units")
    units = rows.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # Witness candidates: the units of each toxic document that speak most for its kind.
    odds = F.log((F.col("t") + 0.1) / (F.col("c") * F.lit(sizes[1] / sizes[0]) + 0.1))
    best = Window.partitionBy("bag").orderBy(F.desc("odds"), "unit")
    likely = rows.where("toxic = 1").join(units.where("c = 0 or t > c").withColumn("odds", odds), "unit").withColumn("place", F.row_number().over(best)).where(F.col("place") <= WITNESSES)
    found = likely.select("bag", "unit", "odds", "t").toArrow().to_pydict()
    if not found["unit"]:
        return Model(np.zeros(_TRIPLES, np.float32), -1.0, 0.0, float(np.log(sizes[1] / sizes[0])))
    clean = store(units.where("c > 0").select("unit", "c"), "toxicity-clean")
    usual = [r["unit"] for r in clean.orderBy(F.desc("c"), "unit").limit(NEGATIVES // 4).collect()]
    others = [r["unit"] for r in clean.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES // 4).collect()]
    bags: dict[int, list[int]] = {}
    place: dict[str, int] = {}
    for bag, unit in zip(found["bag"], found["unit"]):
        bags.setdefault(bag, []).append(place.setdefault(unit, len(place)))
    candidates = list(place)
    strength = np.zeros(len(candidates))
    strength[[place[u] for u in found["unit"]]] = found["odds"]
    top = [candidates[i] for i in np.argsort(-strength, kind="stable")[: LANDMARKS // 2]]
    landmarks = list(dict.fromkeys([*top, *others[: LANDMARKS // 2]]))
    phi, row = _vectors(landmarks)
    values, vectors = np.linalg.eigh((phi.T @ phi).astype(float))
    usable = values > 1e-6 * values.max()
    root = vectors[:, usable] / np.sqrt(values[usable])
    nystroem = (phi @ root).astype(np.float32)

    def features(of: list[str]) -> np.ndarray:
        parts = [_project(nystroem, *_encode(of[i: i + 400]), row) for i in range(0, len(of), 400)]
        return np.hstack([np.vstack(parts).astype(float), np.ones((len(of), 1))])

    zp = features(candidates)
    negatives = list(dict.fromkeys([*usual, *others]))
    witness = {b: max(u, key=lambda i: (strength[i], -i)) for b, u in bags.items()}
    model = Model(np.zeros(_TRIPLES, np.float32), 0.0, 1.0, 0.0)
    for turn in range(ROUNDS):
        zn = features(negatives)
        chosen = np.array(sorted(witness.values()))
        z, y = np.vstack([zp[chosen], zn]), np.concatenate([np.ones(len(chosen)), -np.ones(len(negatives))])
        w = _machine(z, y, np.where(y > 0, 1.0 / len(chosen), 1.0 / len(negatives)) * 2_000)
        margin = zp @ w
        witness = {b: max(u, key=lambda i: (margin[i], -i)) for b, u in bags.items()}
        model.weights, model.bias = (nystroem @ w[:-1]).astype(np.float32)[row], float(w[-1])
        if turn in (0, 1):  # the clean units taken for toxic ones are learned from next
            hard = _ranked(clean, model).orderBy(F.desc("margin"), "unit").limit(NEGATIVES // 4).collect()
            negatives = list(dict.fromkeys([*negatives, *[r["unit"] for r in hard]]))
    held = margins(sample, model, F.struct("toxic")).select("kept.toxic", "margin").toArrow()
    model.slope, model.offset = _platt(held.column("margin").to_numpy(), held.column("toxic").to_numpy())
    return model


def _ranked(units: DataFrame, model: Model) -> DataFrame:
    shared = units.sparkSession.sparkContext.broadcast(model)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _project(shared.value.weights, *_encode(batch.column("unit").to_pylist())) + shared.value.bias
                yield pa.record_batch({"unit": batch.column("unit"), "margin": pa.array(found.astype(float))})

    return units.select("unit").mapInArrow(rank, "unit string, margin double")


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, classes weighted alike, with a little ridge."""
    x = np.column_stack([margin, np.ones(len(margin))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (weight * (p - y)) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def margins(docs: DataFrame, model: Model, kept: Column) -> DataFrame:
    """``kept`` (a struct of any columns) and ``margin``, the largest margin of the whole text's units."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = with_kept(docs, kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(with_text(whole)):
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(_margins(shared.value, batch))], ["kept", "margin"])

    schema = StructType([given.schema["kept"], StructField("margin", DoubleType())])
    return given.mapInArrow(score, schema)


def score(docs: DataFrame, model: Model, kept: Column) -> DataFrame:
    """``kept``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Null and empty texts score as a text without units."""
    z = F.col("margin") * model.slope + model.offset
    p = (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score")
    return margins(docs, model, kept).select("kept", p).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels of held-out ids take no part in the learning."""
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs, model, F.struct("doc_id", (fold("doc_id", 5) == 0).alias("held_out"))).select("kept.*", "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not taken for toxic; all columns stay as they are."""
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs, model, F.struct("*")).where("predicted = 0").select("kept.*")
