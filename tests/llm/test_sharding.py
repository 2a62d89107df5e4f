import zlib
from collections import Counter

from voxtally.llm import sharding


def check(rows, texts):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_counts_and_slots(documents):
    check(sharding.shard(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd):
    check(sharding.shard(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table(nothing):
    assert sharding.shard(nothing).count() == 0


def test_reproducible_whatever_the_partitions(documents):
    one, other = ({(r.doc_id, r.shard, r.slot) for r in sharding.shard(d).collect()} for d in (documents, documents.repartition(7)))
    assert one == other
    assert one != {(r.doc_id, r.shard, r.slot) for r in sharding.shard(documents, seed=1).collect()}


def test_the_way_back(documents):
    placed = sharding.shard(documents)
    rows = sharding.row_numbers_of(placed, placed.count()).collect()
    assert all(r.origin == r.row_number for r in rows)


def test_permutes_every_range(spark):
    for n in (1, 2, 3, 5, 17, 64, 1000):
        places = [r.p for r in sharding.permute(spark.range(n), "id", "p", n, seed=3).collect()]
        assert sorted(places) == list(range(n))


def test_a_row_with_many_copies(spark):
    rows = spark.range(3_000).selectExpr("cast(if(id < 2000, 7, id) as long) as doc_id", "'same' as text")
    numbered = sharding.number_rows(rows, ["doc_id", "text"], 3_000, per_bucket=100).collect()
    assert sorted(r.row_number for r in numbered) == list(range(3_000))
