"""Centroid clustering against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from voxtally.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, uid string, cluster string, near string, distance string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "uid", "cluster", "near", "distance", "v") for i, e in rows], SCHEMA)


def fine(e, dims):
    return e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)


def brute(rows, k, rounds, dims, seed=1):
    held = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if fine(e, dims)]
    order = sorted(range(len(held)), key=lambda r: (held[r][0] is None, hashlib.sha256(f"{seed}:{held[r][0]}".encode()).hexdigest(), r))
    centers = [held[r][1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in held]
        for j in range(len(centers)):
            own = [v for (_, v), x in zip(held, of) if x == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((-1 if i is None else i), j, d) for i, d, j in ((i, *nearest(v)) for i, v in held)), centers


def found(result):
    assigned, centers = result
    rows = assigned.collect()
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in rows), centers.tolist(), sum(r["evaluations"] for r in rows)


@pytest.mark.parametrize("k,rounds,spread", [(16, 3, 1.0), (5, 9, 0.02), (3, 0, 1.0)])
def test_equals_plain_rounds_with_fewer_distances(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    centers = rng.normal(0, 2, (7, 6))
    rows = [(i, (centers[i % 7] + spread * rng.normal(0, 1, 6)).tolist()) for i in range(600)]
    own, final, evaluations = found(centroids.cluster(frame(spark, rows), k, rounds, 6))
    assert (own, final) == brute(rows, k, rounds, 6)
    assert evaluations <= 600 * k * (rounds + 1)
    if rounds == 9:
        assert evaluations < 0.5 * 600 * k * (rounds + 1)  # the bounds spare most of them


def test_ties_repeats_and_empty_clusters(spark):
    rows = [(i % 40, [float(i % 4), 0.0]) for i in range(200)] + [(900 + i, [1.0, 0.0]) for i in range(3)]
    own, final, _ = found(centroids.cluster(frame(spark, rows), 8, 4, 2))
    assert (own, final) == brute(rows, 8, 4, 2)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, math.nan]), (6, [math.inf, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [0.5, -0.001]), (8, [-0.0, 3.0]), (8, [-0.0, 3.0]), (9, [-7.3, 1e7])]
    own, final, _ = found(centroids.cluster(frame(spark, rows), 3, 2, 2))
    assert (own, final) == brute(rows, 3, 2, 2) and len(own) == 4
    assert found(centroids.cluster(frame(spark, rows[:7]), 3, 2, 2)) == ([], [], 0)
    assert found(centroids.cluster(frame(spark, rows[-1:]), 3, 2, 2))[0] == [(9, 0, 0)]


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0 ** 33 + 3.0 * i, -(2.0 ** 33)]) for i in range(20)]
    own, final, _ = found(centroids.cluster(frame(spark, rows), 3, 3, 2))
    assert (own, final) == brute(rows, 3, 3, 2)
    with pytest.raises(Exception, match="not fit a long"):
        found(centroids.cluster(frame(spark, [(1, [1e300, 0.0])]), 3, 3, 2))


def test_a_centroid_that_came_back_has_its_old_bound():
    history = np.array([[[0], [100]], [[40], [100]], [[0], [100]]])
    vectors, near, seen = np.array([[1]]), np.array([[1, 99]], np.float32), np.zeros((1, 2), np.uint8)
    own, _, evaluated = centroids.reassign(vectors, np.array([0]), near, seen, history, False)
    assert own.tolist() == [0] and evaluated.tolist() == [0]  # drifts of 40 and 40 would have asked for a rescan
