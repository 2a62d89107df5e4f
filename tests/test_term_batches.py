"""Terms of Arrow batches against plain counting, grouped patterns and ISO dates."""

import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtally.functions import term_batches as tb
from voxtally.functions.exprs import prefix_pattern
from voxtally.functions.values import parse_date

TEXTS = [["a", "b", "a", "b"], [], ["b"], ["c", "a"], ["a", "b", "é"], []]


def merged(batches):
    out = Counter(), Counter()
    for b in batches:
        for r in b.to_pylist():
            out[0][r["term"]] += r["n"]
            out[1][r["term"]] += r["docs"]
    return out


@pytest.mark.parametrize("words", [1, 4, 1000])
def test_counts_of_terms_and_of_their_texts(monkeypatch, words):
    monkeypatch.setattr(tb, "WORDS", words)
    batch = pa.record_batch({"words": pa.array([["cut"], *TEXTS], pa.list_(pa.string()))}).slice(1)
    pairs = [[f"{a} {b}" for a, b in zip(t, t[1:]) if a in "ac"] for t in TEXTS]
    for got, texts in ((tb.count_words([batch]), TEXTS), (tb.count_pairs(SimpleNamespace(value=["a", "c", "zzz"]))([batch]), pairs)):
        n, docs = merged(got)
        assert n == Counter(t for x in texts for t in x) and docs == Counter(t for x in texts for t in set(x))


def test_entries_are_normalised_weights(monkeypatch):
    monkeypatch.setattr(tb, "WORDS", 3)
    vocabulary, idf, at, got = ["a", "a b", "b", "q"], np.array([1.0, 2.0, 3.0, 4.0]), 0, []
    lists = pa.array([*TEXTS, None], pa.list_(pa.string()))
    for count, owner, term, weight in tb.entries(lists, pa.array(vocabulary), pa.array(["a"]), idf):
        got += [(at + o, t, w) for o, t, w in zip(owner.tolist(), term.tolist(), weight.tolist())]
        at += count
    assert at == len(lists)
    size = (4 + 16 + 36) ** 0.5
    wanted = [(0, 0, 2 / size), (0, 1, 4 / size), (0, 2, 6 / size), (2, 2, 1.0), (3, 0, 1.0)] + [(4, t, w / 14 ** 0.5) for t, w in ((0, 1), (1, 2), (2, 3))]
    assert [(o, t) for o, t, _ in got] == [(o, t) for o, t, _ in wanted]
    assert [w for *_, w in got] == pytest.approx([w for *_, w in wanted])


def test_many_ways_are_grouped_by_first_letters():
    terms = [f"{a}{b}" for a in "abcdefghijklm^]-\\" for b in ("x", "yz", "")]
    pattern = prefix_pattern(terms)
    assert pattern.count("(?=[") >= 2
    found = re.compile(pattern)
    for text in [*terms, "q", "axx", "byz", "by", "]yz!", "-x", "\\", "^yzz"]:
        known = [t for t in terms if text.startswith(t)]
        match = found.match(text)
        assert (match.group() if match else None) == max(known, key=len, default=None)


def test_iso_dates_need_no_parts(spark):
    given = {"2024-02-29": "2024-02-29", "2023-02-29": None, "2024-13-01": None, "2024-00-10": None, "2024-01-32": None, "0000-01-01": None, " 1677-09-22\n": "1677-09-22",
             "1677-09-21": None, "2262-04-12": None, "2024-1-5": "2024-01-05", "2024-01-05T10:00": "2024-01-05", "२०२४-०१-०१": None}
    rows = spark.createDataFrame([(k,) for k in given], "d string").select("d", parse_date(F.col("d")).cast("string").alias("day")).collect()
    assert {r.d: r.day for r in rows} == given
