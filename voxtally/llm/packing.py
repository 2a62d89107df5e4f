"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Documents are tokenised, cut where they are longer than a sequence, and packed by best-fit decreasing in partitions of bounded size. Lower bounds
from dual feasible functions certify a partition whose bin count they reach; partitions with gaps exchange the documents of their bins
that are not full, and the others those of their emptiest bins, until the whole count is certified or an exchange saves nothing more.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.flat import LOWER, expand, slices, span_hashes, text_bytes, word_spans
from voxtally.llm.tables import store

CAPACITY = 4096
END = 1
#: Pieces of a partition; rounds of exchange; dual feasible functions u_k with k up to STEPS.
PARTITION, ROUNDS, STEPS = 16_384, 12, 24
#: Words whose ids a worker keeps; with more it goes on with those of the last slice.
CACHE = 1_000_000
# Stands between words that are tokenised together; a word that holds it is tokenised by itself.
_BETWEEN = "␞"
# One run of these letters is one pre-token, so the last token of each word tells where the next begins.
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
# Sentence marks, which never share a token with a letter.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?%&$#*|)")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


@dataclass
class Words:
    """The ids of the words that a worker has met: sorted hashes, the word's number for each, and by number where its ids are."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for a new one."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def add(self, hashes: np.ndarray, found: list[bytes]) -> None:
        """New words, which get the next numbers."""
        counts = np.array([len(x) // 4 for x in found], np.int64)
        self.firsts = np.concatenate([self.firsts, len(self.ids) + np.cumsum(counts) - counts])
        self.numbers = np.concatenate([self.numbers, len(self.counts) + np.arange(len(found))])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.numbers = every[order], self.numbers[order]

    def kept(self, numbers: np.ndarray) -> Words:
        """A table of only these words (distinct numbers)."""
        hash_of = np.zeros(len(self.counts), np.uint64)
        hash_of[self.numbers] = self.hashes
        order = np.argsort(hash_of[numbers])
        counts = self.counts[numbers]
        return Words(hash_of[numbers][order], order, np.cumsum(counts) - counts, counts, self.ids[expand(self.firsts[numbers], counts)])


_tokenizers: dict[str, tuple] = {}
_words: dict[str, Words] = {}


def _tokenizer(path: str) -> tuple:
    """(the tokenizer, which ids end a word)."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _tokenizers[path] = tokenizer, ends
    return _tokenizers[path]


def _encode_together(tokenizer, words: list[str], mark: str) -> np.ndarray:
    texts = [mark.join(words[k: k + 1_000]) + mark for k in range(0, len(words), 1_000)]
    return np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def _encode_plain(path: str, words: list[str]) -> dict[str, bytes]:
    """Words of letters only: each is one pre-token and ends with its only end token."""
    tokenizer, ends = _tokenizer(path)
    ids = _encode_together(tokenizer, words, " ")
    stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
    raw = ids.tobytes()
    return {w: raw[a:b] for w, a, b in zip(words, [0, *stops], stops, strict=False)} if len(stops) == len(words) else _encode_others(path, words)


def _encode_others(path: str, words: list[str]) -> dict[str, bytes]:
    """Any words, told apart by a mark."""
    tokenizer, _ = _tokenizer(path)
    alone = [w for w in words if _BETWEEN in w]
    found = {w: np.array(tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in alone}
    words = [w for w in words if _BETWEEN not in w]
    if words:
        mark = np.array(tokenizer.encode(_BETWEEN, add_special_tokens=False).ids, np.uint32)
        ids = _encode_together(tokenizer, words, f" {_BETWEEN} ")
        hit = np.ones(len(ids) - len(mark) + 1, bool)
        for k, m in enumerate(mark):
            hit &= ids[k: k + len(hit)] == m
        ends = np.flatnonzero(hit)
        starts, raw = [0, *(ends[:-1] + len(mark)).tolist()], ids.tobytes()
        found.update((w, raw[4 * a: 4 * b]) for w, a, b in zip(words, starts, ends.tolist()))
    return found


def word_ids(path: str, words: list[str]) -> list[bytes]:
    """The ids of each of some distinct words (no white space inside) as bytes. Words never share a token, so many are tokenised as one text."""
    plain = [w for w in words if _PLAIN.fullmatch(w)]
    found = {}
    for i in range(0, len(plain), 50_000):
        found.update(_encode_plain(path, plain[i: i + 50_000]))
    found.update(_encode_others(path, [w for w in words if w not in found]))
    return [found[w] for w in words]


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lowered, as the tokenizer does itself; but its added tokens ``<|...|>`` only count as they are written, so words
    with ``<|`` keep their letters."""
    folded = LOWER[data]
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for w in np.unique(np.searchsorted(starts, marks, side="right") - 1).tolist():
        folded[starts[w]: ends[w]] = data[starts[w]: ends[w]]
    return folded


def _head_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each word ends without the sentence marks (up to four) after its last letter."""
    out = ends.copy()
    rows = np.arange(len(ends))
    for _ in range(4):
        rows = rows[(out[rows] - starts[rows] > 1) & _TAIL[data[out[rows] - 1]]]
        out[rows] -= 1
    rows = np.flatnonzero(out < ends)
    back = rows[~_LETTER[data[out[rows] - 1]]]
    out[back] = ends[back]
    return out


def token_ids(batch: pa.RecordBatch, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by END; where each text's begin, and the end).

    Words are looked up by 64-bit hashes, without the marks at their end, which are words of their own; only new ones become strings.
    """
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(data, offsets)
    data = _folded(data, starts, ends)
    stops = _head_ends(data, starts, ends)
    marked = np.flatnonzero(stops < ends)
    begins, finals = np.concatenate([starts, stops[marked]]), np.concatenate([stops, ends[marked]])
    hashes = np.concatenate([span_hashes(data, starts, stops), span_hashes(data, stops[marked], ends[marked])])
    known = _words.setdefault(path, Words())
    numbers = known.find(hashes)
    new = np.flatnonzero(numbers < 0)
    if len(new):
        distinct, at, which = np.unique(hashes[new], return_index=True, return_inverse=True)
        raw = data.tobytes()
        numbers[new] = len(known.counts) + which
        known.add(distinct, word_ids(path, [raw[a:b].decode() for a, b in zip(begins[new[at]].tolist(), finals[new[at]].tolist())]))
    # The parts of the texts in order: a word, its marks, the next word, ..., END.
    earlier = np.concatenate(([0], np.cumsum(stops < ends)))
    text = np.repeat(np.arange(batch.num_rows), np.diff(first))
    at_word = np.arange(len(starts)) + earlier[:-1] + text
    at_end = first[1:] + earlier[first[1:]] + np.arange(batch.num_rows)
    order = np.concatenate([at_word, at_word[marked] + 1, at_end])
    place, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = np.concatenate([known.firsts[numbers], np.full(batch.num_rows, len(known.ids))])
    count[order] = np.concatenate([known.counts[numbers], np.ones(batch.num_rows, np.int64)])
    ids = np.append(known.ids, np.uint32(END))[expand(place, count)]
    if len(known.counts) > CACHE:
        _words[path] = known.kept(np.unique(numbers))
    return ids, np.concatenate(([0], np.cumsum(count)[at_end]))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's tokens, cut into pieces of ``capacity`` if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids, begins = token_ids(batch, path)
                total = np.diff(begins)
                n = -(-total // capacity)
                text = np.repeat(np.arange(len(n)), n)
                piece = expand(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(total[text] - start, capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (begins[text] + start).tolist()
                crc = [zlib.crc32(raw[4 * a: 4 * (a + k)]) for a, k in zip(at, length.tolist())]
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(text)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    A dual feasible function maps sizes so that what fits one bin still sums to at most 1; the sum over all sizes then bounds the bins.
    The first family drops sizes under e and rounds those over 1 - e up to 1; the second, u_k, rounds sizes to multiples of 1 / k.
    """
    if not len(lengths):
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((lengths * counts).sum()) // capacity)
    for e in np.unique(lengths[2 * lengths <= capacity]):
        value = np.where(lengths > capacity - e, capacity, np.where(lengths >= e, lengths, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, STEPS + 1):
        up = (k + 1) * lengths
        value = np.where(up % capacity == 0, lengths * k, up // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which come in decreasing order, and the load of each bin.

    The bins with each room are a stack; the rooms in use are the bits of one number, so the smallest room that fits is its lowest bit.
    """
    bins, offsets, loads = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: dict[int, list[int]] = {}
    rooms = 0
    for i, size in enumerate(lengths.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += size
        left = room - size
        if left:
            stack = stacks.setdefault(left, [])
            if not stack:
                rooms |= 1 << left
            stack.append(b)
    return bins, offsets, np.array(loads, np.int64)


def _pack_partition(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, loads = best_fit(lengths, capacity)
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        exchanged = loads < capacity
        if len(loads) == bound:  # certified: only what together could fill a bin more, the emptiest bins first
            order = np.argsort(loads, kind="stable")
            room = np.cumsum(capacity - loads[order])
            exchanged[order[room - (capacity - loads[order]) >= capacity]] = False
        n = len(lengths)
        return pa.table({
            **{c: table.column(c) for c in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")},
            "sequence_id": pa.array(bins + (table.column("part")[0].as_py() << 20)), "offset": pa.array(offsets),
            "open": pa.array(exchanged[bins]), "part_bins": pa.array(np.full(n, len(loads))), "part_bound": pa.array(np.full(n, bound))})

    return run


PACKED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, part_bins long, part_bound long"


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (``doc_id, piece, start, length, ids_crc32``) into sequences; adds ``sequence_id, offset, part_bins, part_bound``.

    ``part_bins`` and ``part_bound`` are the bins of the partition that a piece was packed in and their lower bound; equal: no packing of that
    partition has fewer. A piece as long as a sequence is one by itself. Each exchange packs what is left open in fewer partitions; its
    result is taken only if it has fewer bins than before. An empty table gives no rows.
    """
    cut = store(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most ``capacity`` rows
    sizes, counts = (lengths.column(c).to_numpy().astype(np.int64) for c in ("length", "n"))
    bound = lower_bound(sizes, counts, capacity)
    full = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound"))
    closed = [full]
    final = full.columns
    total = int(counts[sizes == capacity].sum())
    left, rows = cut.where(F.col("length") < capacity), int(counts[sizes < capacity].sum())
    before, held, first_part = None, None, 0
    for turn in range(ROUNDS):
        if not rows:
            break
        parts = -(-rows // PARTITION)
        part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)) + first_part
        given = left.select("uid", "doc_id", "piece", "start", "length", "ids_crc32", part.alias("part"))
        done = store(given.groupBy("part").applyInArrow(_pack_partition(capacity), PACKED), "packed")
        first_part += parts
        bins = done.groupBy("sequence_id").agg(F.first("open").alias("open"), F.count(F.lit(1)).alias("n"))
        stat = {r["open"]: r for r in bins.groupBy("open").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("rows")).collect()}
        now = sum(r["bins"] for r in stat.values())
        if before is not None and now >= before:  # the exchange saved nothing: what was there stays
            break
        closed.append(done.where(~F.col("open")).select(*final))
        held, before = done.where("open").select(*final), stat[True]["bins"] if True in stat else 0
        total += stat[False]["bins"] if False in stat else 0
        left, rows = done.where("open"), stat[True]["rows"] if True in stat else 0
        if total + before <= bound or parts == 1:
            break
    if held is not None:
        closed.append(held)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound``, a row for each piece of a document.

    A document is its text's ids by the tokenizer file ``path`` and then END; only longer ones are cut. Null and empty texts are END alone.
    Repeated rows are documents of their own; null ids stay null; other columns are ignored.
    """
    return pack(pieces(docs, path, capacity), capacity)
