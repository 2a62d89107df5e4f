"""Exact top-k and embedding near-duplicates against brute force."""

import math

import numpy as np
import pytest

from voxtally.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, node string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, "id", "v", "node", "score") for i, e, label in rows], SCHEMA)


def fine(e):
    return e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e)


ODD = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (5, [1.0, math.nan, 0.0], 0), (6, [math.inf, 0.0, 0.0], 0), (7, [1.0, 0.0, 0.0], None),
       (8, [1.0, 0.0, 0.0], 0), (9, [2.0, 0.0, -0.0], 0), (10, [1.0, 0.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.01, 0.0], 0), (20, [1.0, 0.0], 0), (40, [1.0, 0.0, 0.0], 0), (0, [0.5, 0.5, 0.0], 0)]


def brute_top(rows, k):
    held = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e, _ in rows if i is not None and fine(e)]
    out = []
    for q in sorted({i for i, _ in held if i % 20 == 0}):
        own = min(v for i, v in held if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in held if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def top(spark, rows, k):
    given = topk.quantised(vectors(spark, rows))
    return sorted(tuple(r) for r in topk.top_k(given.where("id % 20 = 0"), given, k).collect())


@pytest.mark.parametrize("query_block,candidate_block", [(512, 4_096), (3, 17)])
def test_top_k_equals_brute_force(spark, monkeypatch, query_block, candidate_block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", candidate_block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 7).astype(float).tolist(), 0) for i in range(200)]  # few values: many ties
    assert top(spark, rows, 20) == brute_top(rows, 20)


def test_top_k_odd_rows(spark):
    assert top(spark, ODD, 3) == brute_top(ODD, 3)
    assert top(spark, [], 3) == [] and top(spark, [(20, [1.0], 0)], 3) == []


def test_products_stay_exact():
    a = np.array([[3 << 27, 1]])
    assert topk._products(a, a)[0][0, 0] == (3 << 27) ** 2 + 1
    wide = a << 20
    product, unsure = topk._products(np.concatenate([wide, a]), np.concatenate([wide, a, [[-5, 7 << 45]]]))
    assert unsure.tolist() == [[True, True, True], [True, False, False]]
    assert product[1, 2] == -5 * (3 << 27) + (7 << 45)


def test_top_k_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(40, [1e8, 1e8], 0), (20, [-1e8, 1.0], 0), *((100 + i, (rng.normal(0, 1, 2) * 10.0 ** rng.integers(0, 8)).tolist(), 0) for i in range(60))]
    assert top(spark, rows, 20) == brute_top(rows, 20)
    halves = [(20, [1e9, -1e9, 1e9, 1.0], 0), (1, [1e9, 1e9, 1.0, 2.0], 0), (2, [1e9, 1e9, 3.0, 5.0], 0), (3, [-1e9, -1e9, 0.0, 9.0], 0), (4, [1.0, 0.0, 0.0, 0.0], 0)]
    assert top(spark, halves, 3) == brute_top(halves, 3)  # the shares of the slices do not fit a long, the scores do
    with pytest.raises(Exception, match="does not fit a long"):
        top(spark, [(20, [1e9, 1e9], 0), (1, [1e9, 1e9], 0)], 3)
    with pytest.raises(Exception, match="does not fit a long"):
        top(spark, [(20, [1e9, 1e9], 0), (1, [-1e9, -1e9], 0)], 3)
    assert [r[2] for r in top(spark, [(20, [1e9, 1e9], 0), (1, [-1e9, -1e9], 0), (2, [1.0, 1.0], 0)], 1)] == [2]


def brute_links(rows, threshold=0.93):
    ok = [fine(e) and any(e) and label is not None for _, e, label in rows]
    links = [[0] * len(rows) for _ in rows]
    for a, (_, x, la) in enumerate(rows):
        for b, (_, y, lb) in enumerate(rows):
            if a != b and ok[a] and ok[b] and la == lb and len(x) == len(y):
                x64, y64 = (np.array(v, np.float32).astype(float) for v in (x, y))
                links[a][b] = int(x64 @ y64 / np.linalg.norm(x64) / np.linalg.norm(y64) >= threshold)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if links[a][b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in set(label)}
    return sorted(((r[0] is None, r[0]), sum(n), (least[g] is None, least[g]), r[0] == least[g]) for r, n, g in zip(rows, links, label))


def near(spark, rows):
    return sorted(((r.vec_id is None, r.vec_id), r.n_links, (r.component_id is None, r.component_id), r.kept) for r in near_vectors.near_duplicates(vectors(spark, rows)).collect())


@pytest.mark.parametrize("block", [2_048, 13])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] * rng.choice([0.5, 2.0]) + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.4])).tolist(), i % 2) for i in range(150)]
    assert near(spark, rows) == brute_links(rows)


def test_links_odd_rows(spark):
    assert near(spark, ODD) == brute_links(ODD)
    assert near(spark, []) == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((400, 64))
    unit[200:] = unit[:200] + 0.3 * rng.standard_normal((200, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = [near_vectors.encode(unit, seed) for seed in (0, 1)]
    assert codes[0][0].shape == (400, 32) and codes[0][0].dtype == np.uint8
    (first, first_error), (second, second_error) = (near_vectors.decode(*codes[seed], 64, seed) for seed in (0, 1))
    true, estimate = unit @ unit.T, first @ second.T
    assert abs((estimate - true).mean()) < 0.003
    limits = near_vectors.lower_limits(first_error, second_error, 64, 0.93)
    assert (estimate >= limits)[true >= 0.93].all() and (true >= 0.93).sum() > 400
    assert (estimate < limits)[true < 0.6].mean() > 0.99  # few others need an exact cosine
    spread = ((estimate - true) / np.sqrt(((first_error[:, None] + second_error) * (1 - true ** 2) + first_error[:, None] * second_error) / 63)).std()
    assert 0.9 < spread < 1.1  # the standard deviation that the limits are made of


def test_links_beyond_the_range_of_squares(spark):
    far = "vec_id long, embedding array<double>, label int"
    rows = spark.createDataFrame([(1, [1e200, 2e200], 0), (2, [1.0, 2.0], 0), (3, [1e-200, 2e-200], 0), (4, [2.0, -1.0], 0)], far)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(rows).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
