"""Periodic runs against a search of every period and start."""

import hashlib
import random
import re
import zlib

import pytest

from voxtally.llm import periodic

SCHEMA = "doc_id long, text string, row string, period string, lo string, words string"


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, q, length) for (start, length), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_row(doc_id, text):
    words = split(text)
    runs = brute_runs(words)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4), *sha), kept


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "row", "period", "lo", "words") for i, t in texts], SCHEMA)


def made(seed, count=120):
    """Words of a small alphabet, with repeated stretches, some inside others."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        words = [rng.choice("abc"[: rng.choice((1, 2, 3))]) for _ in range(rng.choice((0, 1, 5, 6, 7, 8, 30, 200)))]
        for _ in range(rng.choice((0, 1, 2, 4))):
            unit = [rng.choice("abcdef") for _ in range(rng.choice((1, 2, 3, 4, 7, 8, 15, 16, 33)))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * rng.randint(2, 9))[: rng.choice((6, 8, 20, 130, 400))]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("span", [1 << 16, 64, 8])
def test_equals_brute_force_on_one_task_and_dealt_out(spark, span):
    texts = made(span)
    given = frame(spark, texts)
    found = sorted((r["doc_id"], r["start"], r["period"], r["length"]) for r in periodic.runs(given, span).collect())
    assert found == sorted((i, *r) for i, t in texts for r in brute_runs(split(t))) and len(found) > 100
    for digests in (True, False):
        rows = periodic.collapse(given, digests, span).cache()
        assert sorted(map(tuple, periodic.digest(rows).collect())) == sorted(brute_row(i, t)[0] for i, t in texts)
        if not digests:
            assert {r["doc_id"]: r["collapsed"] for r in rows.collect()} == {i: brute_row(i, t)[1] for i, t in texts}


def test_one_word_many_times_and_words_of_a_self_similar_sequence(spark):
    bits = "0"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("01", "10"))  # no run at all: never three times the same in a row
    texts = [(1, "go " * 5_000), (2, " ".join(bits)), (3, " ".join(bits[:1024] * 4)), (4, "a b " * 700 + "a a a a a a"), (5, "a b c d e f g")]
    rows = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in periodic.digest(periodic.collapse(frame(spark, texts), True)).collect()}
    assert rows == {1: (1, 0, 5_000, 1), 2: (0, None, None, None), 3: (1, 0, 4096, 1024), 4: (2, 0, 1401, 2), 5: (0, None, None, None)}


def test_odd_documents(spark, odd, nothing):
    rows = periodic.digest(periodic.collapse(odd, True)).collect()
    expected = [brute_row(r["doc_id"], r["text"])[0] for r in odd.select("doc_id", "text").collect() if r["doc_id"] != 8]
    assert sorted((tuple(r) for r in rows if r["doc_id"] != 8), key=str) == sorted(expected, key=str)
    assert [tuple(r)[1:6] for r in rows if r["doc_id"] == 8] == [(1, 0, 27_000, 3, 9_000_000)]
    assert periodic.collapse(nothing).count() == 0 and periodic.runs(nothing).count() == 0


def test_repeated_tail(spark, documents, odd):
    def plain(doc_id, text):
        words, h = split(text), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if doc_id is None or h % 10 or not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))

    for docs in (documents, odd):
        before = sorted(((r["doc_id"], plain(r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect()), key=str)
        assert sorted((tuple(r) for r in periodic.repeated_tail(docs).collect()), key=str) == before


def test_query_equals_brute_force(spark, documents):
    rows = sorted(map(tuple, periodic.digest(periodic.collapse(periodic.repeated_tail(documents), True)).collect()))
    texts = periodic.repeated_tail(documents).collect()
    texts = [r for r in texts if len(split(r["text"])) < 3_000]
    ids = {r["doc_id"] for r in texts}
    assert [r for r in rows if r[0] in ids] == sorted(brute_row(r["doc_id"], r["text"])[0] for r in texts)
    assert sum(r[1] > 0 for r in rows) > 10
