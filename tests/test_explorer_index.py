"""Indexed filters and searches give the rows of plain ones and read fewer files."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from voxtally.operators import explore, explorer_index

THEMES, SENTIMENTS, SEVERITIES, SOURCES = ["fees", "refund_delay", "otp"], ["negative", "positive", "mixed"], ["low", "high", "critical"], ["email", "phone", None, "chat"]
SCHEMA = "feedback_id string, source string, sentiment string, primary_theme string, secondary_themes string, severity string, intent string, requires_human_review boolean, analysis_method string, pii_detected boolean, masked_text string"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i, (t, s, v, c) in enumerate(itertools.product(THEMES, SENTIMENTS, SEVERITIES, SOURCES)):
        for k in range(20):
            text = " ".join(rng.choices(["alpha", "beta", "gamma", "Délta", "ep.silon"], k=5)) + f" {t} number{i}"
            rows.append((f"F{i}-{k}", c, s, t, "", v, "complaint", k % 3 == 0, "keyword_rule", k % 2 == 0, text if k else None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def indexed(table, tmp_path_factory):
    return explorer_index.write(table, str(tmp_path_factory.mktemp("explorer") / "x"), rows=40)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("filters", [
    {"primary_themes": ["fees"]}, {"sentiments": ["negative"], "severities": ["high", "critical"]}, {"sources": ["email"], "pii_detected": "Yes", "primary_themes": ["otp"]},
    {"sources": ["nowhere"]}, {"search_query": "number17\\b"}, {"search_query": "NUMBER33 *$|zzz(yyy|xxx)"}, {"search_query": "fees number.*", "severities": ["low"]}, {"search_query": "d.lt"}, {},
])
def test_same_rows_from_fewer_files(table, indexed, filters):
    got = indexed.filter(**filters)
    assert rows(got) == rows(explore.filter_explorer(table, **filters)) and got.columns == table.columns
    chosen, every = indexed.blocks(**filters), indexed.rows().select("block").distinct().count()
    if chosen is None:
        assert filters in ({}, {"search_query": "d.lt"})
    else:
        assert len(chosen) < every / 2
        scans = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
        assert not chosen or all("block" in x.split("PartitionFilters:")[1].split("]")[0] for x in scans)


def test_needed_trigrams():
    need = explorer_index.needed_trigrams
    assert need("refund.*pending|signup") == [{"ref", "efu", "fun", "und", "pen", "end", "ndi", "din", "ing"}, {"sig", "ign", "gnu", "nup"}]
    assert need("(abc|xbd)+x?") == [{"abc"}, {"xbd"}] and need("a.b") is None and need("abc|d") is None and need("(abc)*") is None
    for odd in ("(?i)abcd", r"\Qabc\E", "[a&&[b]]cde", "abc(", r"abc\x41", "ab*+cde"):
        assert need(odd) is None
    rng = random.Random(2)
    for _ in range(400):  # whatever matches has one of the sets
        pattern = "".join(rng.choices(["a", "b", "c", "ab", "bca", ".", "(ab|cab)", "a?", "(b|c)*", "[ab]", "^", "$", "c+", "(abc){2}"], k=rng.randint(1, 6)))
        sets = need(pattern)
        for _ in range(30 if sets else 0):
            text = "".join(rng.choices("abc", k=rng.randint(3, 14)))
            if re.search(pattern, text):
                assert any(all(g in text for g in s) for s in sets)


def test_an_empty_table(spark, table, tmp_path):
    empty = explorer_index.write(table.where(F.lit(False)), str(tmp_path / "x"))
    assert empty.filter(primary_themes=["fees"], search_query="abc").count() == 0 and empty.search("abc").columns == table.columns
