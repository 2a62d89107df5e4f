"""TF-IDF, the fallback and clusters against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voxtally import fixed
from voxtally.operators import analysis as an
from voxtally.operators import groups, kmeans, similarity
from voxtally.plans import pipeline
from voxtally.sources.taxonomy import load_rules


def words(text):
    runs = re.findall(r"[\wऀ-ॿ]+", text.lower())
    trimmed = [re.sub(r"^\W+|\W+$", "", r) for r in runs]
    return [t for t in trimmed if t]


def terms(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def fit(texts, size):
    counts = Counter(t for x in texts for t in terms(x))
    vocabulary = sorted(t for t, _ in sorted(counts.items(), key=lambda i: (-i[1], i[0]))[:size])
    df = Counter(t for x in texts for t in set(terms(x)))
    return vocabulary, {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocabulary}


def weights(text, idf):
    raw = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
    norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
    return {t: v / norm for t, v in raw.items()}


def corpus(n=60):
    rng = random.Random(3)
    pool = ["pay", "Refund", "slow", "app", "the", "देर", "की", "x", "été", "a_b", "9", "fee"]
    return [" ".join(rng.choice(pool[: rng.randint(2, 12)]) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", " -"]) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "_row_number long, feedback_id string, masked_text string")


@pytest.mark.parametrize("buckets", [3, 64, 1 << 18])
@pytest.mark.parametrize("size", [1, 7, 30])
def test_leading_terms_are_exact_in_any_number_of_buckets(spark, monkeypatch, buckets, size):
    monkeypatch.setattr(similarity, "BUCKETS", buckets)
    rng = random.Random(size)
    rows = [f"w{int(rng.paretovariate(0.7))}" for _ in range(1500)] + [f"tie{i % 20}" for i in range(100)]
    got = similarity.leading_terms(spark.createDataFrame([(t,) for t in rows], "term string"), size, "t").collect()
    assert [(r.term, r.n) for r in got] == sorted(Counter(rows).items(), key=lambda i: (-i[1], i[0]))[:size]


def test_rare_terms_are_not_counted_one_by_one(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("w"), F.col("id") % 40)).otherwise(F.col("id").cast("string")).alias("term"))
    rows = similarity._with_bucket(rows)
    totals = similarity._bucket_totals(rows, "t")
    assert rows.select("term").distinct().count() == 20_020
    assert similarity._counted(rows, totals.where("total >= 1000")).count() < 50  # the 20 frequent ones and what shares a bucket with them


@pytest.mark.parametrize("direct", [0, similarity.DIRECT_WORDS])
@pytest.mark.parametrize("size", [6, 25, 5000])
def test_fit_with_cut_vocabulary(spark, monkeypatch, size, direct):
    monkeypatch.setattr(similarity, "DIRECT_WORDS", direct)
    texts = corpus()
    model = similarity.tfidf_fit(frame(spark, [*texts, None, "nan", " "]), size=size)
    vocabulary, idf = fit(texts, size)
    assert list(model.vocabulary) == vocabulary and model.documents == len(texts)
    assert model.idf == pytest.approx([idf[t] for t in vocabulary])


def test_vectors(spark):
    texts = corpus(20)
    df = frame(spark, texts)
    model = similarity.tfidf_fit(df, size=15)
    _, idf = fit(texts, 15)
    got = {}
    for row in similarity.tfidf_vectors(df, model, "feedback_id").collect():
        got.setdefault(row.feedback_id, {})[row.term] = row.weight
    for i, text in enumerate(texts):
        assert got.get(str(i), {}) == pytest.approx(weights(text, idf))


def test_fallback(spark):
    rules = load_rules()
    texts = ["slow waiting for the app to load", "money and payment with the merchant", "zzz qqq", "refund pending", "Payment failed, money was deducted", None]
    df = frame(spark, texts)
    got = {r.feedback_id: r.theme_result for r in an.classify_themes_batch(df, rules).collect()}
    _, idf = fit([t for t in texts if t], 5000)
    refs = [weights(" ".join([*r["phrases"], *r["keywords"]]), idf) for r in rules]
    for i in (0, 1, 3):
        own = weights(texts[i], idf)
        sims = [round(sum(v * ref.get(t, 0) for t, v in own.items()), 12) for ref in refs]
        best = max(range(len(rules)), key=lambda k: (sims[k], -k))
        assert got[str(i)].primary_theme == rules[best]["theme"] and got[str(i)].method == "tfidf_fallback"
        assert got[str(i)].primary_confidence == pytest.approx(min(0.55, sims[best]))
        assert got[str(i)].matched_terms == ["tfidf_similarity"] and got[str(i)].requires_human_review
    assert got["2"].primary_theme == "unknown" and got["4"].method == "keyword_rule" and got["5"].method == "unknown"
    assert similarity.tfidf_fit(frame(spark, [None, " ", "!!"])) is None


def test_cluster_bounds(spark):
    assert [groups.choose_k(n, k) for n, k in ((0, None), (1, 5), (3, None), (100, None), (100, 20), (2, 7), (9, 1))] == [0, 1, 3, 5, 8, 2, 1]
    none = groups.cluster_feedback(frame(spark, [None, " "]))
    assert none.warnings == [fixed.MSG_CLUSTER_NO_TEXT] and none.members.where("cluster_id is not null").count() == 0
    single = groups.cluster_feedback(frame(spark, ["only one", None]))
    assert single.warnings == [fixed.MSG_CLUSTER_SINGLE] and [r.cluster_id for r in single.members.orderBy("_row_number").collect()] == [0, None]
    assert groups.cluster_terms(single).count() == 0


def test_clusters(spark):
    texts = ["refund pending refund"] * 6 + ["app crash crash"] * 5 + ["otp code late"] * 4 + [None]
    df = frame(spark, texts)
    found = groups.cluster_feedback(df, k=3)
    labels = [r.cluster_id for r in found.members.orderBy("_row_number").collect()]
    assert labels[-1] is None and [len(set(labels[a:b])) for a, b in ((0, 6), (6, 11), (11, 15))] == [1, 1, 1]
    again = groups.cluster_feedback(df, k=3)
    assert labels == [r.cluster_id for r in again.members.orderBy("_row_number").collect()]
    rows = groups.cluster_summary(found).collect()
    assert sorted(r.cluster_size for r in rows) == [4, 5, 6] and all(r.warning == fixed.MSG_CLUSTER for r in rows)
    assert {"refund", "crash", "otp"} <= {t for r in rows for t in r.representative_terms}
    assert all(len(r.representative_terms) <= 5 for r in rows)
    assert groups.cluster_feedback(frame(spark, ["a b", "c d"]), k=5).warnings == [fixed.MSG_CLUSTER_REDUCED]
    with_ids = pipeline.with_clusters(an.analyze_feedback(df), found).orderBy("_row_number")
    plain = an.analyze_feedback(df).orderBy("_row_number")
    assert with_ids.drop("cluster_id").collect() == plain.drop("cluster_id").collect()  # clusters change nothing else
    assert [r.cluster_id for r in with_ids.collect()] == labels


def test_all_starts_in_one_pass_are_as_good_as_single_fits(spark):
    rng = random.Random(6)
    topics = [["refund", "money", "pending"], ["app", "crash", "slow"], ["otp", "code", "late"], ["fee", "charge", "bill"], ["agent", "call", "rude"], ["login", "locked", "user"]]
    texts = [" ".join(rng.choices(rng.choice(topics), k=6) + rng.choices(["the", "my", "again", "please"], k=3)) for _ in range(400)]
    found = groups.cluster_feedback(frame(spark, texts), k=6)
    rows = found.members.select("cluster_id", vector_to_array("tfidf").alias("x")).collect()
    x, label = np.array([r.x for r in rows]), np.array([r.cluster_id for r in rows])
    far = ((x[:, None] - found.centres[None]) ** 2).sum(2)
    assert (far.argmin(1) == label).all() and found.cost == pytest.approx(far.min(1).sum())
    for c in range(6):
        assert np.allclose(found.centres[c], x[label == c].mean(0), atol=1e-3)
    training = found.members.select("tfidf")
    costs = [KMeans(k=6, seed=fixed.CLUSTER_SEED + s, featuresCol="tfidf").fit(training).summary.trainingCost for s in range(10)]
    assert found.cost <= min(costs) * 1.001


def test_vectors_are_stored_in_small_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.concatenate((rng.integers(0, 30, 6000), np.zeros(2000, int), [1500, 0, 3]))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    indices, values, numbers = rng.integers(0, 5000, ends[-1]).astype(np.int32), rng.random(ends[-1]), rng.integers(-2**62, 2**62, len(sizes))
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (indices, values)]
    batch = pa.RecordBatch.from_arrays([*lists, pa.array(numbers)], ["i", "v", "h"])
    packed = [*kmeans._pack(iter([batch.slice(0, 5), batch.slice(5), batch.slice(0, 0)]))]
    stored = spark.createDataFrame([r for p in packed for r in p.to_pylist()], kmeans._BLOCK).coalesce(1)
    largest = stored.selectExpr("max(length(rows) + length(indices) + length(values) + length(numbers)) AS bytes", "count(*) AS n").first()
    assert largest.bytes < 30_000 and largest.n > 200

    monkeypatch.setattr(kmeans, "VECTORS", 700)
    monkeypatch.setattr(kmeans, "COMPONENTS", 1000)
    portions = [x for p in packed for x in kmeans._portions(p)] + [*kmeans._portions(packed[1].slice(0, 0))]
    assert all(len(s) <= 700 and (s.sum() <= 1000 or len(s) == 1) for s, *_ in portions)
    for k, wanted in enumerate((sizes, indices, values, numbers)):
        assert np.array_equal(np.concatenate([p[k] for p in portions]), wanted)


def test_portions_and_stored_rows_make_no_difference(spark, monkeypatch):
    df = frame(spark, [*corpus(200), None, "zzz", *["refund pending"] * 50])
    model = similarity.tfidf_fit(df, size=12)  # a text without a listed term has an empty vector
    whole = groups.cluster_feedback(df, k=4, model=model)
    monkeypatch.setattr(kmeans, "ROW_BYTES", 100)
    cut = groups.cluster_feedback(df, k=4, model=model)
    assert np.allclose(whole.centres, cut.centres, atol=1e-9) and whole.cost == pytest.approx(cut.cost)
    labels = [[r.cluster_id for r in c.members.orderBy("_row_number").collect()] for c in (whole, cut)]
    assert labels[0] == labels[1]


def test_models_are_saved_in_versions(spark, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError, match="no model"):
        similarity.load_model(spark, path)
    first, second = (similarity.tfidf_fit(frame(spark, corpus(n))) for n in (10, 20))
    assert [similarity.save_model(spark, m, path) for m in (first, second)] == [1, 2]
    (tmp_path / "models" / "version-3").mkdir()  # a write that has not ended
    assert similarity.load_model(spark, path) == (second, 2) and similarity.load_model(spark, path, 1) == (first, 1)
    with pytest.raises(FileNotFoundError, match="no such version"):
        similarity.load_model(spark, path, 3)
