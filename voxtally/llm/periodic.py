"""Periodic runs of words, found in scale-tiled pieces and stitched.

Each document is cut into overlapping tiles, anew for every octave of periods. In the octave of periods 2 ** k to 2 ** (k + 1) - 1, tiles are centred on the multiples of B = 2 ** (k + 1)
and reach 2 B words to both sides. A run of at least four periods holds such a centre with a whole period on both sides, and its tiles cover all of it.

A tile is solved by itself. Cheap comparisons of single words tell which periods may match across its centre; if there are any, two
boundary Z-functions give, for all periods at once, how far the match goes on to the right and to the left inside the tile. Each match is a fragment: words
equal to those one period later, from ``lo`` to ``hi``. Fragments of one document and period that touch are stitched, first in the task, then after a shuffle by document and
period. What is then long enough and has no shorter period in the same place is a run.

Documents of more than ``SPAN`` words are dealt out: groups of neighbouring tiles become records of their own, with their words as numbers, and go to other tasks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.llm.flat import slices, span_hashes, text_bytes, word_spans
from voxtally.llm.tables import partitions, store

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 6, 4
#: Words of a document that are solved in one task; tiles of longer ones are dealt out in groups of about as many words.
SPAN = 1 << 16
#: Pairs of a centre and a period that are compared at once.
PAIRS = 1 << 18


def z_function(s: list[int], n: int) -> list[int]:
    """For each of the first ``n`` places how many elements from there equal those from the start."""
    z = [0] * n
    left = right = 0
    size = len(s)
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < size and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(words: list[int], centre: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(period, lo, hi)`` for the ``periods`` that match one whole period across the centre: words lo .. hi - 1 equal those a period later.

    The first Z-function is that of the right half followed by the words around the centre: it tells how long the words from one period before
    the centre go on like those after it. The second is that of the left half, read backwards.
    """
    longest = max(periods)
    before, after = words[:centre], words[centre:]
    from_here = len(after) + 1
    across = z_function([*after, -1, *before[-longest:], *after], from_here + min(longest, centre))
    back = before[::-1]
    backward = z_function(back, min(longest + 1, len(back)))
    for q in periods:
        to_right = across[from_here + min(longest, centre) - q]
        if to_right >= q:
            to_left = backward[q] if q < len(back) else 0
            yield q, centre - q - to_left, centre - q + to_right


def fragments(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, octave: int, least: int) -> dict[tuple[int, int], list[list[int]]]:
    """``{(document, period): [[lo, hi], ...]}`` of the periods in an octave, in places of the documents (``words[starts[d]: ends[d]]``)
    with at least ``least`` words."""
    low = 1 << octave
    step = 2 * low
    fit = np.flatnonzero(ends - starts >= least)
    count = np.maximum((ends[fit] - starts[fit] - 1) // step, 0)
    doc = np.repeat(fit, count)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + 1) * step
    centre, first, stop = place + starts[doc], starts[doc], ends[doc]
    periods = np.arange(low, 2 * low)
    tiles: dict[int, list[int]] = defaultdict(list)
    for begin in range(0, len(centre), max(1, PAIRS // low)):
        rows = slice(begin, begin + max(1, PAIRS // low))
        c, q = centre[rows, None], periods[None, :]
        inside = (c - q >= first[rows, None]) & (c + q <= stop[rows, None])
        same = inside & (words[np.maximum(c - q, 0)] == words[c])
        i, k = np.nonzero(same)
        for shift in (1, low // 2 + 1):  # other places of the period before the centre
            at = centre[rows][i] - shift
            ok = words[at] == words[at + periods[k]]
            i, k = i[ok], k[ok]
        for tile, period in zip((i + begin).tolist(), periods[k].tolist()):
            tiles[tile].append(period)
    found: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
    for tile, likely in tiles.items():
        b, d = int(centre[tile]), int(doc[tile])
        a = max(int(first[tile]), b - 2 * step)
        own = words[a: min(int(stop[tile]), b + 2 * step)].tolist()
        for q, lo, hi in solve_tile(own, b - a, likely):
            lo, hi = lo + a - int(starts[d]), hi + a - int(starts[d])
            known = found[d, q]
            if known and known[-1][1] >= lo:  # tiles come in order: stitch inside the task
                known[-1] = [min(known[-1][0], lo), max(known[-1][1], hi)]
            else:
                known.append([lo, hi])
    return found


def _solved(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, octaves: list[int]) -> list[tuple[int, int, int, int]]:
    """``(document, period, lo, hi)`` of whole documents: what is long enough for a run, and of several periods of one stretch the smallest."""
    best: dict[tuple[int, int, int], int] = {}
    for octave in octaves:
        for (d, q), parts in fragments(words, starts, ends, octave, max(LEAST, EXPONENT << octave)).items():
            for lo, hi in parts:
                if hi + q - lo >= max(LEAST, EXPONENT * q):
                    key = d, lo, hi + q
                    best[key] = min(q, best.get(key, q))
    return [(d, q, lo, hi - q) for (d, lo, hi), q in best.items()]


def _octaves(n: int) -> list[int]:
    """All octaves that can hold the period of a run in ``n`` words."""
    return list(range(max(0, (n // EXPONENT).bit_length()))) if n >= LEAST else []


_FOUND = "kind byte, row long, doc_id long, n_words long, text string, sha256 string, period long, lo long, hi long, octave int, words binary"


def _record(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    kinds = {"kind": pa.int8(), "row": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "text": pa.string(), "sha256": pa.string(), "period": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "octave": pa.int32(), "words": pa.binary()}
    return pa.record_batch({c: (given[c] if isinstance(given.get(c), (pa.Array, pa.ChunkedArray)) else pa.array(given[c], t)) if c in given else pa.nulls(n, t) for c, t in kinds.items()})


def _fragment_rows(rows: list, found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return _record(kind=[1] * len(found), row=[rows[d] for d, *_ in found], period=[x[1] for x in found], lo=[x[2] for x in found], hi=[x[3] for x in found])


def _search(span: int, all_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a row for each document, with its text if it may hold runs or all are asked for, else its digest. Kind 1: a fragment. Kind 2: tiles for another task."""
        for whole in batches:
            for batch in slices(whole, size=4 << 20):
                data, offsets = text_bytes(batch.column("text"))
                starts, ends, first = word_spans(data, offsets)
                words = span_hashes(data, starts, ends)
                n = np.diff(first)
                rows = batch.column("row").to_pylist()
                short = np.flatnonzero(n <= span)
                found = _solved(words, first[short], first[short + 1], _octaves(int(n[short].max(initial=0))))
                found = [(int(short[d]), q, lo, hi) for d, q, lo, hi in found]
                yield _fragment_rows(rows, found)
                held = set(range(len(n))) if all_texts else {d for d, *_ in found}
                for d in np.flatnonzero(n > span).tolist():
                    numbers = np.unique(words[first[d]: first[d + 1]], return_inverse=True)[1].astype(np.int32)
                    held.add(d)
                    for octave in _octaves(len(numbers)):
                        step = 2 << octave
                        group = max(1, span // step) * step
                        for begin in range(0, len(numbers), group):  # centres begin + step .. begin + group
                            a, b = max(0, begin - step), min(len(numbers), begin + group + 2 * step)
                            packed = zstandard.ZstdCompressor(level=1).compress(numbers[a:b].tobytes())
                            yield _record(kind=[2], row=[rows[d]], lo=[a], octave=[octave], words=[packed])
                texts = batch.column("text").to_pylist()
                sha = [None if d in held else hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for d, t in enumerate(texts)]
                yield _record(kind=[0] * len(n), row=batch.column("row"), doc_id=batch.column("doc_id"), n_words=n, text=[t if d in held else None for d, t in enumerate(texts)], sha256=sha)

    return run


def _solve_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, lo, octave, packed in zip(*(batch.column(c).to_pylist() for c in ("row", "lo", "octave", "words"))):
            words = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32).astype(np.int64)
            # Every period is passed on: which stretches are the same shows only when they are whole.
            found = [(q, a + lo, b + lo) for (_, q), parts in fragments(words, np.zeros(1, np.int64), np.array([len(words)]), octave, 0).items() for a, b in parts]
            yield pa.record_batch({"row": pa.array([row] * len(found), pa.int64()), "period": pa.array([x[0] for x in found], pa.int64()), "lo": pa.array([x[1] for x in found], pa.int64()), "hi": pa.array([x[2] for x in found], pa.int64())})


def stitch(pieces: DataFrame) -> DataFrame:
    """``row, start, length, period`` from fragments ``row, period, lo, hi``: those of one row and period that touch are one; then what is long
    enough counts, and of the periods of one stretch the smallest."""
    order = Window.partitionBy("row", "period").orderBy("lo", "hi")
    apart = F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy("row", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    whole = whole.select("row", "start", (F.col("hi") + F.col("period") - F.col("start")).alias("length"), "period")
    long = whole.where(F.col("length") >= F.greatest(F.lit(LEAST), EXPONENT * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _searched(docs: DataFrame, span: int, all_texts: bool) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = store(texts.mapInArrow(_search(span, all_texts), _FOUND), "tiles")
    dealt = found.where("kind = 2").select("row", "lo", "octave", "words").repartition(partitions(docs.sparkSession), "row", "octave", "lo")
    more = dealt.mapInArrow(_solve_dealt, "row long, period long, lo long, hi long")
    pieces = found.where("kind = 1").select("row", "period", "lo", "hi").union(more)
    return found.where("kind = 0"), store(stitch(pieces), "runs")


def runs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``row, doc_id, start, length, period`` of every run of every document ``doc_id, text``; ``row`` tells documents with one id apart.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared by 64-bit hashes. A run is a stretch of words with smallest period q and at least max(6, 4 q) words that
    can't be extended with period q. Null and empty texts have none; repeated rows each have theirs; an empty table gives no rows; other columns are ignored.
    """
    documents, found = _searched(docs, span, False)
    return found.join(documents.select("row", "doc_id"), "row").select("row", "doc_id", "start", "length", "period")


def _collapsed(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drop what runs repeat and join the rest by one blank."""
        for batch in batches:
            out = []
            for text, own, sha in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "sha256"))):
                if sha is not None and not keep_text:
                    out.append((None, sha))
                    continue
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in own or ():
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                joined = b" ".join([w for w, k in zip(words, kept.tolist()) if k])
                out.append((joined.decode() if keep_text else None, hashlib.sha256(joined).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("runs"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
                ["row", "doc_id", "runs", "collapsed", "collapsed_sha256"])

    return run


def collapse(docs: DataFrame, digests: bool = False, span: int = SPAN) -> DataFrame:
    """``row, doc_id, runs, collapsed, collapsed_sha256`` for every document; ``runs`` is the array of (start, length, period), by start, then period, or null.

    ``collapsed`` are the words that no run repeats, joined by one blank: a word goes if a run holds it after the run's first period. With ``digests`` the
    texts stay null and only texts with a possible run are moved at all. Nulls, empty texts and repeated rows: as ``runs`` says; a text without words
    collapses to an empty one.
    """
    documents, found = _searched(docs, span, not digests)
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    ordered = F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    given = documents.join(lists, "row", "left").select("row", "doc_id", "text", ordered.alias("runs"), "sha256")
    return given.mapInArrow(_collapsed(not digests), "row long, doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string, collapsed_sha256 string")


def repeated_tail(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with periodic endings set in, by which a table without runs gets some.

    Of a document of n words with h = crc32(doc_id in decimal), g = h div 10 and h mod 10 = 0, every word i >= a becomes word a + (i - a) mod p; a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). The words of such a text are joined by one blank; other texts, and null ids, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("_h"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    chosen = chosen.withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    chosen = chosen.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("_h div 10"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.transform(F.sequence(F.col("_a"), F.col("_n") - 1), lambda i: F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    text = F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail)
    return chosen.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` from ``collapse``'s rows; the first
    four after ``n_runs`` are of the longest run (ties: smallest start, then period), null without one."""
    own = F.coalesce("runs", F.array().cast("array<struct<start: long, length: long, period: long>>"))
    best = F.array_max(F.transform(own, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(own, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size(own).cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed_sha256")
    period = -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
