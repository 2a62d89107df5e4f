"""Records whose fields go on in the next line, against Python's reader, with split edges everywhere."""

import csv as plain
import io
import random

import pytest

from voxtally.session import stage
from voxtally.sources import csv_records, feedback_csv

SIZES = (16, 90, 500)
TAGGED = csv_records.tagged_lines


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Scan the lines, and only them, in splits of a few bytes."""

    def use(size):
        def tagged(session, path):
            session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            session.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                return stage(TAGGED(session, path), "small-splits")
            finally:
                session.conf.unset("spark.sql.files.maxPartitionBytes")
                session.conf.unset("spark.sql.files.openCostInBytes")

        monkeypatch.setattr(csv_records, "tagged_lines", tagged)

    return use


def made(seed, records, newline="\n"):
    """A file of three fields with quotes, commas and line breaks in them, and quotes that mean nothing."""
    rng = random.Random(seed)
    out = ["id,text,more"]
    for i in range(records):
        words = rng.choices(["a", "bb", '""', ",", newline, newline * 2, "é", " ", "_"], k=rng.randint(0, 9))
        text = '"' + "".join(words) + '"' if rng.random() < 0.5 else rng.choice(["plain", '5" screen', 'say "hi"', "x"])
        out.append(f"{i},{text}," + rng.choice(['"', "", 'y"', '"q"', '"q\nr"', "z"]).replace("\n", newline))
        if out[-1].endswith(',"'):
            out[-1] += 'end"'
        if rng.random() < 0.05:
            out.append("")
    return newline.join(out) + newline


def expected(data):
    """Python's reader, but a blank line is no record."""
    rows = [r for r in plain.reader(io.StringIO(data, newline=""), strict=False) if r][1:]
    return [(n + 2, *r) for n, r in enumerate(rows)]


def read(spark, path):
    rows = feedback_csv.read_feedback_csv(spark, str(path), multiline=True).rows
    return sorted(((r["_row_number"], r["id"], r["text"], r["more"]) for r in rows.collect()), key=str)


def nulls(rows):
    return sorted(((n, *(None if v in feedback_csv.NULL_TEXTS else v for v in r)) for n, *r in rows), key=str)


@pytest.mark.parametrize("size", SIZES)
def test_any_split_edge_gives_the_same_records(spark, tmp_path, small_splits, size):
    data = made(size, 60)
    (tmp_path / "one.csv").write_text(data, newline="")
    small_splits(size)
    assert csv_records.tagged_lines(spark, str(tmp_path)).select("_split").distinct().count() > min(20, len(data) // size // 2)
    assert read(spark, tmp_path) == nulls(expected(data))


def test_carriage_returns_marks_and_several_files(spark, tmp_path, small_splits):
    texts = [made(k, 25, "\r\n" if k % 2 else "\n") for k in range(4)]
    for k, data in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(("﻿" if k == 2 else "").encode() + data.encode())
    small_splits(40)
    assert read(spark, tmp_path) == sorted((x for data in texts for x in nulls(expected(data))), key=str)


def test_a_field_over_many_splits_and_a_header_over_lines(spark, tmp_path, small_splits):
    data = 'id,text,"mo\nre"\n1,"' + "line\n" * 200 + '",x\n\n2,b,y\n3,"c\n",z'
    (tmp_path / "one.csv").write_text(data)
    small_splits(64)
    rows = feedback_csv.read_feedback_csv(spark, str(tmp_path / "one.csv")).rows.orderBy("_row_number").collect()
    assert [(r["_row_number"], r["id"], r["text"]) for r in rows] == [(2, "1", "line\n" * 200), (3, "2", "b"), (4, "3", "c\n")]


def test_one_odd_quote_moves_only_its_split(spark, tmp_path, small_splits):
    body = [f'{i},{"5" + chr(34) + " screen" if i == 700 else "text"},m' for i in range(1_000)]
    (tmp_path / "one.csv").write_text("\n".join(["id,text,more", *body]) + "\n")
    small_splits(2_000)
    states = csv_records.split_states(csv_records.tagged_lines(spark, str(tmp_path)))
    assert states.count() > 5 and states.where("plain and state = 0").count() == states.count()  # that quote opens nothing
    found = csv_records.csv_records(spark, str(tmp_path))
    assert found.count() == 1_000 and (702, "700", '5" screen', "m") in read(spark, tmp_path)
    (tmp_path / "one.csv").write_text("\n".join(["id,text,more", *body[:300], '300,"a\nb",m', *body[300:]]) + "\n")
    states = csv_records.split_states(csv_records.tagged_lines(spark, str(tmp_path)))
    assert states.where("not plain").count() <= 2 and len(read(spark, tmp_path)) == 1_001


def test_a_quote_that_is_never_closed_and_too_many_fields(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('id,text,more\n1,"a,b\n2,c,d\n')
    with pytest.raises(feedback_csv.MalformedCsvError, match="never closed"):
        feedback_csv.read_feedback_csv(spark, str(path))
    path.write_text('id,text,more\n1,"a\n",b\n2,c,d,"e\n"\n')
    with pytest.raises(feedback_csv.MalformedCsvError, match="Row 3 "):
        feedback_csv.check_rows_readable(feedback_csv.read_feedback_csv(spark, str(path)))
