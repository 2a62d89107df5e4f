"""Each stage on its own input, and the whole run against what is planted."""

import hashlib

import corpus_pipeline as pipeline
from voxtally.llm import jaccard

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


def test_order_of_the_stages():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard", "secret_scan", "best_fit_packing"]


def test_whole_run(spark, documents, labels, tmp_path):
    rows = pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in rows}
    known = {r.doc_id for r in documents.collect()}
    assert ids <= known and len(ids) > 0.6 * len(known)
    assert {r.part_bins >= r.part_bound for r in rows} == {True}


def test_stages_keep_the_columns(spark, odd, nothing):
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, nothing, SF).count() == 0, name
    assert STAGES["best_fit_packing"](spark, nothing, SF).count() == 0


def test_language_drops_what_has_none(spark, odd):
    ids = {r.doc_id for r in STAGES["language_id"](spark, odd, SF).collect()}
    assert {0, 1, 2, 9}.isdisjoint(ids) and {3, 4, 5} <= ids


def test_near_copies_leave_one(spark, tmp_path):
    base = [hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(200)]
    edit = lambda k: " ".join([*base[:k], "changed", *base[k + 1:]])
    other = " ".join(reversed(base))
    spark.createDataFrame([(5, " ".join(base)), (3, edit(50)), (9, edit(100)), (4, other), (None, " ".join(base)), (7, other)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in STAGES["ngram_jaccard"](spark, docs, SF).collect()) == [3, 4]
    assert jaccard.group(docs, 5, 80).select("component_id").distinct().count() == 2


def test_secrets_go_and_lengths_follow(spark, documents):
    key = hashlib.sha1(b"y").hexdigest()
    planted = documents.limit(20).selectExpr("doc_id", f"concat(text, ' token = \"{key}\" end') as text", "lang", "source", "n_chars")
    rows = STAGES["secret_scan"](spark, planted, SF).collect()
    assert len(rows) == 20 and all(key not in r.text and r.text.endswith('token = "[SECRET]" end') and r.n_chars == len(r.text) for r in rows)
