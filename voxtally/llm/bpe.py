"""Byte-level BPE encoding and decoding through one global table of distinct words.

Texts are taken in blocks of bounded size. A block's pre-tokens become a list of its distinct words and, for each text, positions in that list.
Only the distinct words are shuffled, by hash, packed into one record for each block and bucket; a bucket encodes each of its words once
and sends the ids back to the blocks, where the texts are put together by position. Decoding joins the ids of a text with the token-byte table, which
has a row for each rank and is held by every worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.flat import expand, slices, span_hashes, text_bytes
from voxtally.llm.tables import partitions

#: Text bytes of a block; one longer text is a block of its own.
BLOCK_BYTES = 24 << 20
#: Packed words that a bucket holds about, by which the number of buckets follows the number of blocks.
BUCKET_BYTES, WORD_BYTES_OF_BLOCK = 32 << 20, 8 << 20


def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file (base64 token, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass
class TokenBytes:
    """The token-byte table by id: where each token's bytes begin in ``data``, and how many they are (-1: no such id)."""

    starts: np.ndarray
    lengths: np.ndarray
    data: np.ndarray

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after the other; an unknown id is an error."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the token-byte table")
        return self.data[expand(self.starts[ids], self.lengths[ids])].tobytes()


_tables: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    if path not in _tables:
        table = ranks(path)
        lengths = np.full(max(table.values(), default=-1) + 1, -1, np.int64)
        lengths[list(table.values())] = [len(token) for token in table]
        full = np.maximum(lengths, 0)
        by_rank = sorted((rank, token) for token, rank in table.items())
        _tables[path] = TokenBytes(np.cumsum(full) - full, lengths, np.frombuffer(b"".join(token for _, token in by_rank), np.uint8))
    return _tables[path]


_encoders: dict = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        _encoders[path, pattern] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _encoders[path, pattern]


def _pack(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.tobytes())


def _unpack(packed: bytes, dtype: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive slices that make up about ``size`` bytes of text."""
    held, total = [], 0
    for whole in batches:
        for part in slices(whole, size=size // 4):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and total + own > size:
                yield held
                held, total = [], 0
            held.append(part)
            total += own
    if held:
        yield held


def _hash(words: pa.Array) -> np.ndarray:
    """A stable number for each word, by which it finds its bucket."""
    data, offsets = text_bytes(words)
    return span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64) & np.int64(0x7FFFFFFF)


def _split(block: list[pa.RecordBatch], pattern) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each pre-token's place among them, number of pre-tokens of each text)."""
    places, counts = [], []
    vocabulary: dict[str, int] = {}
    for part in block:
        for text in part.column("text").to_pylist():
            found = pattern.findall(text) if text else []
            counts.append(len(found))
            places.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int32, len(found)))
    words = pa.array(vocabulary.keys(), pa.string())
    return words, np.concatenate(places) if places else np.zeros(0, np.int32), np.array(counts, np.int64)


def _block_id(n: int) -> int:
    return TaskContext.get().partitionId() * (1 << 32) + n


def _word_records(pattern: str, buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        for n, block in enumerate(_blocks(batches, size)):
            words, _, _ = _split(block, split)
            if not len(words):
                continue
            bucket = _hash(words) % buckets
            order = np.argsort(bucket, kind="stable")
            words, bucket = words.take(pa.array(order)), bucket[order]
            begin = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
            data, offsets = text_bytes(words)
            packed = [_pack(data[offsets[a]: offsets[b]]) for a, b in zip(begin[:-1], begin[1:])]
            lengths = [_pack(np.diff(offsets[a: b + 1]).astype(np.uint32)) for a, b in zip(begin[:-1], begin[1:])]
            yield pa.record_batch({"bucket": pa.array(bucket[begin[:-1]].astype(np.int64)), "block": pa.array(np.full(len(packed), _block_id(n))), "words": pa.array(packed, pa.binary()), "lengths": pa.array(lengths, pa.binary())})

    return run


def _encode_bucket(path: str, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        """Encode each distinct word of a bucket once; back go the ids for each block."""
        encoder = _encoder(path, pattern)
        known: dict[bytes, bytes] = {}
        out = []
        for block, words, lengths in zip(table.column("block").to_pylist(), table.column("words").to_pylist(), table.column("lengths").to_pylist()):
            data = bytes(_unpack(words))
            ends = np.cumsum(_unpack(lengths, np.uint32).astype(np.int64)).tolist()
            ids, at = [], 0
            for end in ends:
                word = data[at:end]
                at = end
                found = known.get(word)
                if found is None:
                    found = known[word] = np.array(encoder.encode_ordinary(word.decode()), "<u4").tobytes()
                ids.append(found)
            out.append((table.column("bucket")[0].as_py(), block, _pack(b"".join(ids)), _pack(np.array([len(x) // 4 for x in ids], np.uint32))))
        names = ("bucket", "block", "ids", "id_counts")
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([row[i] for row in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return run


def _text_records(pattern: str, buckets: int, size: int):
    """Each block's texts as packed positions; words are numbered in the order of (bucket, first use), as their records are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        for n, block in enumerate(_blocks(batches, size)):
            words, places, counts = _split(block, split)
            if len(words):
                order = np.argsort(_hash(words) % buckets, kind="stable")
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order), dtype=np.int32)
                places = number[places]
            ids = pa.concat_arrays([x.column("doc_id") for x in block])
            yield pa.record_batch({"block": pa.array([_block_id(n)]), "doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "counts": pa.array([counts.tolist()], pa.list_(pa.int64())), "n_words": pa.array([len(words)], pa.int64()), "places": pa.array([_pack(places)], pa.binary())})

    return run


def _assemble(path: str, digests: bool):
    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        """The ids of each text by position, and the bytes that these ids give."""
        words, table = words.sort_by("bucket"), token_bytes(path)

        def joined(column: str) -> np.ndarray:
            parts = [_unpack(x, np.uint32) for x in words.column(column).to_pylist()]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

        ids, counts_of = joined("ids"), joined("id_counts").astype(np.int64)
        starts = np.cumsum(counts_of) - counts_of
        out = []
        for doc_ids, counts, total, packed in zip(*(texts.column(c).to_pylist() for c in ("doc_ids", "counts", "n_words", "places"))):
            if total != len(counts_of):
                raise RuntimeError("the texts changed between two reads")
            places = _unpack(packed, np.int32)
            at = 0
            for doc_id, n in zip(doc_ids, counts):
                own = places[at: at + n]
                at += n
                tokens = ids[expand(starts[own], counts_of[own])].astype("<u4")
                raw, decoded = tokens.tobytes(), table.decode(tokens)
                out.append((doc_id, len(tokens), *((hashlib.sha256(x).hexdigest() for x in (raw, decoded)) if digests else (raw, decoded))))
        kinds = (pa.int64(), pa.int64(), *[pa.string() if digests else pa.binary()] * 2)
        names = ("doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")))
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded``: the bytes of ``ids`` (little-endian unsigned 32-bit integers), joined with the token-byte table of the rank file ``path``.

    Null ids give null, empty ones no bytes; an id that is not in the table is an error; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            found = [None if x is None else table.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(found, pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each whole text: ids as little-endian unsigned 32-bit integers, decoded the ids' bytes.

    With ``digests`` their SHA-256 in hex comes instead (``ids_sha256, decoded_sha256``). Each match of ``pattern`` is encoded by itself, without
    special tokens. Null texts count as empty: no ids. Repeated rows each give a row; other columns are ignored. ``docs`` is read twice
    and must come from a table, so that its blocks are the same both times; blocks whose words differ in number are an error.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Both passes see the same columns, so their batches, and with them the blocks, are the same.
    splits = texts.rdd.getNumPartitions()
    buckets = max(partitions(spark), splits * WORD_BYTES_OF_BLOCK // BUCKET_BYTES)
    words = texts.mapInArrow(_word_records(pattern, buckets, block_bytes), "bucket long, block long, words binary, lengths binary")
    known = words.groupBy("bucket").applyInArrow(_encode_bucket(path, pattern), "bucket long, block long, ids binary, id_counts binary")
    packed = texts.mapInArrow(_text_records(pattern, buckets, block_bytes), "block long, doc_ids array<long>, counts array<long>, n_words long, places binary")
    both = packed.groupBy("block").cogroup(known.groupBy("block"))
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return both.applyInArrow(_assemble(path, digests), f"doc_id long, n_tokens long, {kinds}")
