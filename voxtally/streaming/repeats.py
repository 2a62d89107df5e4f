"""Repeated ids and texts on a stream, with a correction for the first row once its key comes again."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voxtally.operators.quality import text_key
from voxtally.session import importable
from voxtally.streaming.stream import write_updates

STORE = "spark.sql.streaming.stateStore.providerClass"
#: The only state store that has timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hashed buckets of keys; rows that need no state are dealt over them.  A stream must go on with the number that it began with.
BUCKETS = 2048
#: Bytes of a key's SHA-256.
DIGEST = 32


def _one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch with one key only the latest keeps its key: it stands for all in the state, and the others are known to repeat.

    However many rows a key has, the task that holds its state gets one from each Arrow batch.
    """
    for batch in batches:
        key, when = batch.column("key"), batch.column("ms").fill_null(0).to_numpy()
        code = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((when, code))
        last = np.ones(len(code), bool)
        last[:-1] = code[order][1:] != code[order][:-1]
        stands = np.zeros(len(code), bool)
        stands[order] = last
        stands &= code >= 0
        known = (code >= 0) & (np.bincount(code + 1, minlength=1)[code + 1] > 1)
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["key"] = pc.if_else(pa.array(stands), key, pa.nulls(len(key), key.type))
        yield pa.RecordBatch.from_pydict({**columns, "known": pa.array(known)})


class _FirstSeen(StatefulProcessor):
    """Remembers the first row of each key until ``keep`` milliseconds of event time after its last one.

    The keys of a hashed bucket are one state, so that Python and the store are asked once for a bucket and batch, not several times for each key.
    A bucket has one timer: the earliest end of a key in it.
    """

    def __init__(self, number: str, flag: str, keep: int):
        self.number, self.flag, self.keep = number, flag, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "timer long, digests binary, numbers binary, untils binary, marks binary")

    def _read(self) -> tuple[int | None, dict[bytes, list]]:
        """(timer, [number, repeated, until] of each key)"""
        if not self.first.exists():
            return None, {}
        timer, digests, numbers, untils, marks = self.first.get()
        digests = bytes(digests)
        keys = (digests[i: i + DIGEST] for i in range(0, len(digests), DIGEST))
        rows = zip(np.frombuffer(numbers, np.int64).tolist(), np.frombuffer(untils, np.int64).tolist(), bytes(marks))
        return timer, {key: [None if mark & 2 else number, bool(mark & 1), until] for key, (number, until, mark) in zip(keys, rows)}

    def _write(self, timer: int | None, seen: dict[bytes, list]) -> None:
        """The timer may be earlier than the end of any key: then it only looks again."""
        earliest = min(until for _, _, until in seen.values())
        if timer is None or earliest < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
            timer = earliest
        self.first.update((
            timer, b"".join(seen), np.array([number or 0 for number, _, _ in seen.values()], np.int64).tobytes(),
            np.array([until for _, _, until in seen.values()], np.int64).tobytes(),
            bytes(repeated + 2 * (number is None) for number, repeated, _ in seen.values()),
        ))

    def _out(self, numbers: list, flags: list) -> pd.DataFrame:
        return pd.DataFrame({self.number: pd.Series(numbers, dtype=object), self.flag: pd.Series(flags, dtype=bool)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer = seen = None
        new: dict[bytes, list] = {}  # not put out by any batch yet
        for frame in rows:
            numbers, flags = [], []
            for digest, number, named, ms, known in zip(*(frame[c].tolist() for c in ("key", "number", "named", "ms", "known"))):
                number = number if named else None
                if digest is None:
                    numbers.append(number)
                    flags.append(known)
                    continue
                if seen is None:
                    timer, seen = self._read()
                digest, until = bytes(digest), max(ms, 0) + self.keep
                entry = seen.get(digest)
                if entry is None:
                    seen[digest] = new[digest] = [number, known, until]
                    continue
                if not entry[1] and digest not in new:
                    numbers.append(entry[0])
                    flags.append(True)
                entry[1], entry[2] = True, max(entry[2], until)
                numbers.append(number)
                flags.append(True)
            if numbers:
                yield self._out(numbers, flags)
        if new:
            yield self._out([number for number, _, _ in new.values()], [repeated for _, repeated, _ in new.values()])
        if seen:
            self._write(timer, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, seen = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        left = {digest: entry for digest, entry in seen.items() if entry[2] >= now}
        if left:
            self._write(None, left)
        else:
            self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def flag_repeats_stream(
    feedback: DataFrame, key: Column, flag: str, event_time: str, number: str = "_row_number", late: str = "1 day", keep_days: float = 30, buckets: int = BUCKETS,
) -> DataFrame:
    """``number, flag`` for each row of a stream, and once more, with a true flag, for the first row of a key when the key comes again.

    A flag only ever turns from false to true, so ``latest_flags`` of the rows written so far equals the batch operator on the rows
    read so far, as long as no key is silent for longer than ``keep_days`` of event time: after that its state goes, and its next row counts as
    a first one.  Rows without a key, or without an event time, are false.  Rows older than the watermark (``late``) are dropped.  ``number`` tells the rows
    of the stream apart.  Keys are kept in ``buckets`` states; a batch reads and writes the states of the buckets that its rows fall into, so more of them suit a
    stream of small batches.  Needs the RocksDB state store; ``write_flags`` sets it.
    """
    importable(feedback.sparkSession)
    when = F.col(event_time).cast("timestamp")
    # Rows are grouped as pandas frames, which have no missing long.
    digest, wanted = F.unhex(F.sha2(key, 256)), F.col(number).cast("long")
    rows = feedback.select(
        F.when(when.isNotNull(), digest).alias("key"), F.coalesce(wanted, F.lit(0)).alias("number"), wanted.isNotNull().alias("named"), when.alias("at"))
    rows = rows.withColumn("ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
    known = rows.mapInArrow(_one_of_each, "key binary, number long, named boolean, at timestamp, ms long, known boolean").withWatermark("at", late)
    bucket = F.pmod(F.when(F.col("key").isNull(), F.xxhash64("number")).otherwise(F.xxhash64("key")), F.lit(buckets))
    grouped = known.withColumn("bucket", bucket).groupBy("bucket")
    processor = _FirstSeen(number, flag, int(keep_days * 86_400_000))
    return grouped.transformWithStateInPandas(processor, f"`{number}` long, `{flag}` boolean", "Update", "EventTime")


def flag_duplicate_ids_stream(feedback: DataFrame, event_time: str, **options) -> DataFrame:
    """The stream form of ``flag_duplicate_ids``."""
    return flag_repeats_stream(feedback, F.col("feedback_id"), "duplicate_id", event_time, **options)


def flag_duplicate_text_stream(feedback: DataFrame, event_time: str, **options) -> DataFrame:
    """The stream form of ``flag_duplicate_text``; the state holds digests, not texts."""
    return flag_repeats_stream(feedback, text_key(), "duplicate_text", event_time, **options)


def write_flags(flags: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start the stream with the state store that it needs; the session keeps its own setting for other streams."""
    conf = flags.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKSDB)
    try:
        return write_updates(flags, path, checkpoint)
    finally:
        conf.set(STORE, before)


def latest_flags(spark: SparkSession, path: str, flag: str, number: str = "_row_number") -> DataFrame:
    """One row per row of the stream, with what is known by now."""
    return spark.read.parquet(path).groupBy(number).agg(F.bool_or(flag).alias(flag))
