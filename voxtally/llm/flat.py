"""Whole batches of texts as flat byte arrays: word boundaries and hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; one longer text is worked on alone.
SLICE_BYTES = 1 << 20

# Word bytes are everything but space and the controls 9 to 13.
_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``size`` bytes of text each (or one row)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with a column ``text``; if it has none, that of the rows in ``kept``, without a copy."""
    if "text" in batch.schema.names:
        return batch
    return pa.RecordBatch.from_arrays([*batch.columns, pc.struct_field(batch.column("kept"), "text")], [*batch.schema.names, "text"])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text plus the end) of the words ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[offsets[offsets < len(data)]] = 0
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    ends = offsets[offsets > 0] - 1
    after[ends] = 0
    starts = np.flatnonzero(inside & (1 - before))
    return starts, np.flatnonzero(inside & (1 - after)) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    local = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(local[-1]) + np.repeat(starts - local[:-1], lengths)
    place = np.arange(local[-1]) - np.repeat(local[:-1], lengths)
    values = _BYTE[data[at]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, local[:-1]) + lengths.astype(np.uint64))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after the other."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)
