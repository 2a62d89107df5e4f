"""Repeats on a stream against the batch operators."""

from datetime import datetime, timedelta

import pytest

from voxtally.operators import quality
from voxtally.streaming import repeats, stream

SCHEMA = "_row_number long, feedback_id string, feedback_text string, ts timestamp"
START = datetime(2024, 1, 1)



def run(spark, tmp_path, parts, make, flag, **options):
    """Each part is a file, and a batch of its own, in order."""
    out, state, seen = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "in")
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(seen)
        source = stream.read_feedback_stream(spark, seen, spark.read.parquet(seen).schema, "*.parquet")
        repeats.write_flags(make(source, "ts", **options), out, state).awaitTermination()
    return {r["_row_number"]: r[flag] for r in repeats.latest_flags(spark, out, flag).collect()}


def part(n, rows, day=0):
    return [(100 * n + i, key, text, START + timedelta(days=day, minutes=i)) for i, (key, text) in enumerate(rows)]


PARTS = [
    part(0, [("a", "Hello"), ("b", " x "), (None, None), ("", ""), ("c", "one"), ("c", "ONE ")]),
    part(1, [("a", "other"), ("d", "X"), (None, "  ")], 1),
    part(2, [("d", "hello"), ("a", None), ("e", "alone"), *[("hot", "hot")] * 50], 2),
]


@pytest.mark.parametrize("make,batch,flag", [
    (repeats.flag_duplicate_ids_stream, quality.flag_duplicate_ids, "duplicate_id"),
    (repeats.flag_duplicate_text_stream, quality.flag_duplicate_text, "duplicate_text"),
])
def test_flags_equal_the_batch(spark, tmp_path, make, batch, flag):
    rows = spark.createDataFrame([r for p in PARTS for r in p], SCHEMA)
    expected = {r["_row_number"]: r[flag] for r in batch(rows).collect()}
    assert run(spark, tmp_path, PARTS, make, flag) == expected


def test_rows_without_a_time_pass(spark, tmp_path):
    untimed = [(n, "a", "t", None) for n in (500, 501)]
    parts = [part(0, [("a", "t"), ("b", "t")]) + untimed[:1], untimed[1:], part(1, [("b", "t")])]
    assert run(spark, tmp_path, parts, repeats.flag_duplicate_ids_stream, "duplicate_id") == {0: False, 1: True, 500: False, 501: False, 100: True}


def test_a_silent_key_starts_anew(spark, tmp_path):
    parts = [part(0, [("a", "t")]), part(1, [("z", "t")], 40), part(2, [("y", "t")], 41), part(3, [("a", "t")], 41), part(4, [("z", "t")], 42)]
    flags = run(spark, tmp_path, parts, repeats.flag_duplicate_ids_stream, "duplicate_id", keep_days=10)
    assert flags == {0: False, 100: True, 200: False, 300: False, 400: True}


def test_only_one_row_of_a_key_and_arrow_batch_needs_state():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "key": pa.array(["h", None, "h", "k", "h"]), "number": pa.array([1, 2, 3, 4, 5]), "at": pa.array([0, 0, 0, 0, 0]), "ms": pa.array([5, 1, 9, 2, 7]),
    })
    (out,) = repeats._one_of_each(iter([batch]))
    assert out.column("key").to_pylist() == [None, None, "h", "k", None]
    assert out.column("known").to_pylist() == [True, False, True, False, True]
    (none,) = repeats._one_of_each(iter([batch.slice(0, 0)]))
    assert none.num_rows == 0


def test_a_bucket_asks_the_store_once_for_all_its_keys():
    import pandas as pd

    class Store:
        def __init__(self):
            self.value, self.calls, self.timers = None, 0, set()

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def getCurrentWatermarkInMs(self):
            return 150

    def put(*rows):
        frame = pd.DataFrame(rows, columns=["key", "number", "named", "ms", "known"])
        return sorted((r.n, r.f) for out in state.handleInputRows((0,), iter([frame]), None) for r in out.itertuples())

    key = lambda n: bytes([n]) * repeats.DIGEST
    store, state = Store(), repeats._FirstSeen("n", "f", 100)
    state.init(store)
    assert put(*[(key(n), n, True, n, False) for n in range(200)], (None, 900, True, 0, True)) == [(n, False) for n in range(200)] + [(900, True)]
    assert store.calls == 1 and store.timers == {100}
    assert put((key(7), 300, True, 60, False), (key(7), 301, True, 50, False)) == [(7, True), (300, True), (301, True)]
    assert store.calls == 3
    assert list(state.handleExpiredTimer((0,), store, None)) == []
    store.timers.discard(100)
    assert sorted(state._read()[1]) == [key(7), *(key(n) for n in range(50, 200))] and store.timers == {150}


def test_a_missing_number_is_kept(spark, tmp_path):
    parts = [[(None, "a", "t", START), (1, "b", "t", START)], part(1, [("a", "t")])]
    assert run(spark, tmp_path, parts, repeats.flag_duplicate_ids_stream, "duplicate_id") == {None: True, 1: False, 100: True}
