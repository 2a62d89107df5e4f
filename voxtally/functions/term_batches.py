"""Words and word pairs of Arrow batches, as numbers: what a task counts or weighs without a row for each occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task works on at once; a longer text is taken whole.
WORDS = 2_000_000
COUNTED = "term string, n long, docs long"


def _slices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ends of the rows, words) of some rows at a time."""
    offsets, words = np.asarray(lists.offsets).astype(np.int64), lists.flatten()
    offsets = offsets - offsets[0]
    at, last = 0, len(offsets) - 1
    while at < last:
        end = min(last, max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS, side="right")) - 1))
        yield offsets[at: end + 1] - offsets[at], words.slice(int(offsets[at]), int(offsets[end] - offsets[at]))
        at = end


def _coded(offsets: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, number of each word, words by number)."""
    coded = words.dictionary_encode()
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different numbers in order, how often each is there); a plain sort is several times faster than numpy's ``unique``."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.diff(np.append(begins, len(keys)))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different numbers in order, place of each given one among them)."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return found[new], number


def _totals(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each number, and rows that hold it."""
    return np.bincount(codes, minlength=size), np.bincount(_distinct(rows * size + codes)[0] % size, minlength=size)


def _pairs(rows: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, second) of neighbouring words whose first one is wanted."""
    kept = np.flatnonzero((rows[1:] == rows[:-1]) & first[codes[:-1]])
    return rows[kept], codes[kept], codes[kept + 1]


def _joined(dictionary: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(dictionary.take(pa.array(first)), dictionary.take(pa.array(second)), " ")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of some texts: how often it is there and in how many of them."""
    for batch in batches:
        for offsets, words in _slices(batch.column(0)):
            rows, codes, dictionary = _coded(offsets, words)
            if len(codes):
                n, docs = _totals(rows, codes, len(dictionary))
                yield pa.RecordBatch.from_arrays([dictionary, pa.array(n), pa.array(docs)], ["term", "n", "docs"])


def count_pairs(firsts):
    """The same for word pairs that begin with one of the words of a broadcast list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(firsts.value, pa.string())
        for batch in batches:
            for offsets, words in _slices(batch.column(0)):
                rows, codes, dictionary = _coded(offsets, words)
                if len(codes) < 2:
                    continue
                rows, a, b = _pairs(rows, codes, pc.is_in(dictionary, known).to_numpy(zero_copy_only=False))
                if len(rows):
                    distinct, number = _numbered(a * len(dictionary) + b)
                    n, docs = _totals(rows, number, len(distinct))
                    terms = _joined(dictionary, distinct // len(dictionary), distinct % len(dictionary))
                    yield pa.RecordBatch.from_arrays([terms, pa.array(n), pa.array(docs)], ["term", "n", "docs"])

    return run


def entries(lists: pa.ListArray, vocabulary: pa.Array, firsts: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: (rows, row of each entry, term number, normalised weight), by row and term number.

    ``firsts`` are the first words of the vocabulary's pairs.
    """
    size = len(vocabulary)
    for offsets, words in _slices(lists):
        count = len(offsets) - 1
        rows, codes, dictionary = _coded(offsets, words)
        at = pc.index_in(dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner, term = rows, at[codes] if len(codes) else codes
        if len(codes) > 1:
            pair_rows, a, b = _pairs(rows, codes, pc.is_in(dictionary, firsts).to_numpy(zero_copy_only=False))
            if len(pair_rows):
                distinct, number = _numbered(a * len(dictionary) + b)
                joined = _joined(dictionary, distinct // len(dictionary), distinct % len(dictionary))
                pair_at = pc.index_in(joined, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, term = np.concatenate((owner, pair_rows)), np.concatenate((term, pair_at[number]))
        listed = term >= 0
        found, times = _distinct(owner[listed] * size + term[listed])
        owner, term = found // size, found % size
        weight = times * idf[term]
        norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=count))
        yield count, owner, term, weight / norm[owner]
