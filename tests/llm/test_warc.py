"""WARC archives: round trips, pushed predicates, files of other writers, revisits."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from voxtally.llm import warc

BIG = "<p>" + "same words " * 120 + "</p>"
PAGES = [
    (1, "http://a.example/x", BIG), (7, "http://a.example/y z\r\nWARC-Type: revisit", BIG), (5, None, BIG), (7, "http://a.example/again", BIG), (2, "http://b.example/", None), (3, "http://b.example/", ""),
    (4, "http://b.example/s", "short"), (6, "http://b.example/s", "short"), (None, "http://c.example/", BIG + "!"), (None, "http://c.example/", BIG + "!"), (8, "http://c.example/", "été \u0000 \U0001f600 WARC/1.1\r\n\r\nWARC-Type: x " * 60),
]
SCHEMA = "page_id long, url string, html string, row string, digest string, payload string, id string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "row", "digest", "payload", "id") for r in rows], SCHEMA)


def brute(rows):
    data = [(i, (html or "").encode()) for i, _, html in rows]
    out = []
    for at, (i, body) in enumerate(data):
        same = [(j is not None, j, k) for k, (j, other) in enumerate(data) if other == body]
        best = max(same, key=lambda x: (x[0], x[1] or 0, x[2]))
        revisit = len(body) >= 1000 and best[2] != at
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best[1] if revisit else None, True))
    return sorted(out, key=str)


def test_pages_there_and_back(spark):
    assert sorted(map(tuple, warc.archived(pages(spark, PAGES)).collect()), key=str) == brute(PAGES)
    assert warc.archived(pages(spark, [])).count() == 0


def test_query_equals_brute_force(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in given.collect()]
    assert sorted(map(tuple, warc.archived(given.union(given.limit(9))).collect()), key=str) == brute(rows + rows[:9])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/pages"
    warc.archive(pages(spark, PAGES).repartition(3), path)
    return path


def test_pushed_predicates_and_skipped_blocks(spark, folder, monkeypatch):
    some = warc.records(spark, folder).where("record_type = 'response' and target_uri like 'http://b.%' and refers_to is null")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing is left for Spark
    assert sorted(r["payload"] for r in some.collect()) == [b"", b"", b"short", b"short"]
    assert {r["record_type"] for r in warc.records(spark, folder).where("record_type in ('revisit', 'warcinfo')").collect()} == {"revisit", "warcinfo"}
    assert warc.records(spark, folder).where("payload_length > 1000 and record_type <> 'response'").count() == 4  # the length is no header field: Spark's own filter
    assert warc.records(spark, folder).where("not (record_type = 'revisit') or length(payload) > 0").count() == len(PAGES) - 4 + len(warc.archive_files(folder))

    inflated = []
    monkeypatch.setattr(warc, "add_block", lambda row, block: inflated.append(row["record_id"]) or row)
    for name, _ in warc.archive_files(folder):
        with open(name, "rb") as f:
            rows = list(warc.file_records(f, name, lambda row: row["record_type"] == "revisit"))
            f.seek(0)
            heads = list(warc.file_records(f, name, blocks=False))
        assert {r["record_type"] for r in rows} <= {"revisit"} and len(heads) >= len(rows)
    assert len(inflated) == 4  # only the wanted ones


def test_columns_that_are_not_asked_for_cost_nothing(spark, folder):
    heads = warc.records(spark, folder, ["record_type", "record_id"])
    assert heads.columns == ["record_id", "record_type"] and heads.count() == len(PAGES) + len(warc.archive_files(folder))
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("warc").schema("nothing string").load(folder).count()


def test_only_files_of_the_manifest_count_and_partitions_hold_whole_files(spark, folder):
    names = warc.archive_files(folder)
    with open(names[0][0].rsplit("/", 1)[0] + "/part-left-by-a-lost-task.warc.gz", "wb") as f:
        f.write(b"\x1f\x8bhalf")
    assert warc.archive_files(folder) == names
    assert spark.read.format("warc").option("partition_bytes", 1).load(folder).rdd.getNumPartitions() == len(names)
    assert spark.read.format("warc").load(folder).rdd.getNumPartitions() == 1


def test_archives_of_other_writers(spark, tmp_path):
    payload = b"<p>body</p>\r\n\r\nWARC/1.0\r\nmore"
    http = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n" + payload
    first = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: <http://x.example/>\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) + b"\r\nX-Folded: one\r\n two\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    second = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    forms = {"plain.warc": first + second, "members.warc.gz": gzip.compress(first) + gzip.compress(second), "whole.warc.gz": gzip.compress(first + second), "mixed.warc.gz": warc.member(first) + gzip.compress(second), "_hidden.warc": b"junk", "other.txt": b"junk"}
    for name, data in forms.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.register(spark).read.format("warc").load(str(tmp_path)).orderBy("file", "record_id").collect()
    assert [(r["record_id"], r["payload"]) for r in rows] == [("urn:uuid:1", payload), ("urn:uuid:2", b"abc")] * 4
    assert rows[0]["payload_digest"] == hashlib.sha1(payload).hexdigest() and rows[0]["headers"]["x-folded"] == "one two" and rows[0]["target_uri"] == "http://x.example/"
    assert spark.read.format("warc").load(str(tmp_path)).where("record_type = 'resource'").select("payload").distinct().count() == 1
    (tmp_path / "bad.warc").write_bytes(first[:-20])
    with pytest.raises(Exception, match="malformed record"):
        spark.read.format("warc").load(str(tmp_path / "bad.warc")).count()


def test_member_is_plain_gzip_and_damage_is_noticed():
    data = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert gzip.decompress(warc.member(data)) == data
    broken = bytearray(warc.member(data))
    broken[-6] ^= 1
    with pytest.raises(ValueError, match="malformed"):
        list(warc.file_records(io.BytesIO(bytes(broken)), "x"))


def test_a_hot_payload(spark):
    rows = spark.range(3_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(BIG)).otherwise(F.concat(F.lit(BIG), F.col("id").cast("string"))).alias("html"))
    found = warc.archived(rows)
    assert found.groupBy("record_type", "refers_to").count().orderBy("record_type").collect() == [("response", None, 2_001), ("revisit", 2_997, 999)]
