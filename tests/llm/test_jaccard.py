import random
import re

import numpy as np
import pytest

from voxtally.llm import jaccard
from voxtally.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, size, percent):
    """(doc_id, set size, smallest linked id) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in set(label)}
    return sorted(((i is None, i), len(s), (c is None, c)) for (i, _), s, c in ((r, s, least[g] if s else r[0]) for r, s, g in zip(rows, sets, label)))


def answer(frame, size, percent):
    return sorted(((r.doc_id is None, r.doc_id), r.n_shingles, (r.component_id is None, r.component_id)) for r in jaccard.group(frame, size, percent).collect())


def table(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(path))
    return spark.read.parquet(str(path))


def near_copies(seed):
    """Texts that share lines, copies with a few words changed, and copies of copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzuvw") * rng.randint(1, 3)
    line = [word() for _ in range(12)]
    texts = []
    for _ in range(40):
        texts.append([word() for _ in range(rng.choice([1, 2, 3, 5, 11, 30, 90, 150]))] + (line if rng.random() < 0.4 else []))
    for _ in range(120):
        copy = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy[: len(copy) - rng.choice([0, 0, 1, 3])] or copy)
    rng.shuffle(texts)
    return [(i * 3 % 997, " ".join(t).title() if rng.random() < 0.2 else " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size,percent,block", [(3, 90, 1_024), (5, 80, 1_024), (3, 75, 16)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)  # few sets in a block: cells are searched in pairs of blocks
    rows = near_copies(size * percent)
    assert answer(table(spark, rows, tmp_path / "t"), size, percent) == brute(rows, size, percent)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert answer(odd, 3, 90) == brute(rows, 3, 90)
    assert jaccard.group(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


def test_keep_one(odd):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert ids == sorted([(False, i) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11)] + [(True, None)])  # the null id without text stays, that of "one" goes


def test_front_always_holds_common_neighbours():
    """Random pairs of sets at the edge of similarity share neighbours within both fronts."""
    rng = random.Random(4)
    for _ in range(3_000):
        percent = rng.choice([75, 80, 90, 95])
        n = rng.randint(jaccard.smallest(percent), 60)
        gone = rng.randint(0, n * (100 - percent) // 100)
        new = rng.randint(0, (n - gone) * 100 // percent - n) if (n - gone) * 100 // percent >= n else 0
        a = rng.sample(range(10_000), n)
        b = a[gone:] + rng.sample(range(10_000, 20_000), new)
        if 100 * (n - gone) < percent * (n + new):
            continue
        order = {x: rng.random() for x in {*a, *b}}
        fronts = [sorted(s, key=order.get)[: jaccard.front(len(s), percent)] for s in (a, b)]
        assert {*zip(fronts[0], fronts[0][1:])} & {*zip(fronts[1], fronts[1][1:])} or set(a) == set(b)


def test_search_finds_what_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    index = jaccard.Index(sets, np.arange(80))
    for own in sets:
        for least in (1, 3, max(1, int(0.9 * len(own)))):
            found, common = index.search(own, least)
            truth = {i: len(set(own.tolist()) & set(s.tolist())) for i, s in enumerate(sets)}
            assert dict(zip(found.tolist(), common.tolist())) == {i: n for i, n in truth.items() if n >= least}


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(5, 5), (3, 2), (2, 3)] + [(1_000, 1_000 + i) for i in range(1, 80)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    least = {g: min(k for k, v in label.items() if v == g) for g in label.values()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in rows} == {k: least[v] for k, v in label.items() if k in linked} and len(rows) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
