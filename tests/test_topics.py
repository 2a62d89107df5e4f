"""Sentiment, themes, severity, intent, taxonomies, record analysis."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxtally import fixed
from voxtally.functions import topics
from voxtally.functions.exprs import contained_terms, lexicon_match, prefix_pattern
from voxtally.operators import analysis as an
from voxtally.sources.taxonomy import lexicon, load_rules, load_taxonomy

RULES = load_rules()


def frame(spark, texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "_row_number long, feedback_id string, masked_text string")


def themes(spark, texts, rules=RULES):
    return [r.theme_result for r in an.classify_theme(frame(spark, texts), rules).orderBy("_row_number").collect()]


def test_sentiment(spark):
    texts = ["Easy and smooth and fast and good", "it failed", "great but slow", "nothing", None, "nan", "under order", "unhelpful"]
    got = [r.sentiment_result for r in an.sentiment(frame(spark, texts)).orderBy("_row_number").collect()]
    assert [g.label for g in got] == ["positive", "negative", "mixed", "neutral", "unknown", "unknown", "negative", "positive"]
    assert got[0].score == 1.0 and got[1].score == 1 / 3 and got[4].method == "unknown" and got[4].warning == fixed.MSG_SENTIMENT_MISSING
    assert got[6].matched_negative_terms == ["der"]  # substring matching


def test_one_pass_search_equals_plain_search(spark):
    terms = topics.vocabulary(RULES)
    pattern = re.compile(prefix_pattern(terms))
    assert all(pattern.fullmatch(t) for t in terms) and len(pattern.pattern) < sum(map(len, terms)) * 2
    texts = ["refund still pending and kyc rejected", "App crashes, too many taps", "unhelpful der देर", "", *terms]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", contained_terms(F.lower("t"), terms).alias("h"), lexicon_match(F.lower("t"), terms).alias("o")).collect()
    for row in got:
        expected = [t for t in terms if t in row.t.lower()]
        assert sorted(row.h) == sorted(expected) and row.o == expected


@pytest.mark.parametrize("preset", ["fintech", "saas", "ecommerce", "general"])
def test_every_rule_finds_its_own_terms(spark, preset):
    rules = load_rules(preset)
    got = themes(spark, [" . ".join([*r["phrases"], *r["keywords"]]).lower() for r in rules], rules)
    named = [{g.primary_theme, *(s.theme for s in g.secondary_themes)} for g in got]
    assert all(r["theme"] in n for r, n in zip(rules, named))


def test_scores_ranking_and_review(spark):
    got = themes(spark, [
        "money deducted after failed payment, payment failed",
        "refund pending",
        "nothing relevant",
        None,
        "confusing UI",
        "waiting for refund",
        "app crashes and refund pending and payment failed",
    ])
    assert got[0].primary_theme == "payment_failure" and got[0].primary_confidence == 4 / 4.5
    assert got[0].severity == "critical" and got[0].matched_terms == ["money deducted after failed payment", "payment failed", "deducted"]
    assert got[1].primary_confidence == 0.25 and got[1].requires_human_review
    assert got[2].primary_theme == "unknown" and got[2].method == "keyword_rule" and got[2].warning == fixed.MSG_NO_THEME_EVIDENCE
    assert got[3].method == "unknown" and got[3].warning == fixed.MSG_THEME_MISSING
    assert got[5].primary_confidence == 0.75 and got[5].matched_terms == ["waiting for refund"]  # phrase and keyword: 3 points
    assert [s.theme for s in got[6].secondary_themes] == [] or got[6].primary_theme == "app_performance"
    assert themes(spark, ["confusing UI is here"], load_rules("saas"))[0].primary_theme == "unknown"  # capitals never match


def test_severity_intent_subtheme(spark):
    texts = ["suspected fraud and app crashes", "refund delayed", "kept me on hold", "would like it", "plain",
             "thank you", "not good, thank you", "please add a thing", "why was it so?", "it will crash", "crashed it", "thankful"]
    hits = an.with_hits(frame(spark, texts), RULES)
    rows = hits.select(
        "_row_number", topics.severity(F.col("_hits"), F.lit("medium")).alias("s"),
        topics.intent(F.lower("_text"), F.col("_hits"), F.lit("complaint")).alias("i"),
        topics.subtheme(F.lit("app_performance"), F.col("_hits"), RULES).alias("u"),
    ).orderBy("_row_number").collect()
    assert [r.s for r in rows[:5]] == ["critical", "high", "medium", "low", "medium"]
    assert [r.i for r in rows[5:]] == ["praise", "complaint", "request", "question", "bug_report", "complaint", "complaint"]
    assert rows[0].u == "crash" and rows[4].u == "general"


def test_taxonomies(spark, tmp_path):
    assert [len(load_rules(p)) for p in ("fintech", "saas", "ecommerce", "general")] == [12, 5, 3, 3]
    assert load_rules("nowhere") == load_rules() == load_rules("")
    (tmp_path / "bad.json").write_text("{", "utf-8")
    (tmp_path / "fintech.json").write_text('{"rules": []}', "utf-8")
    assert load_rules("bad", tmp_path) == load_rules() == load_rules("fintech", tmp_path)
    (tmp_path / "own.json").write_text('{"rules": [{"theme": "t", "keywords": ["k"], "phrases": []}]}', "utf-8")
    assert load_rules("own", tmp_path)[0]["default_severity"] == "medium"
    table = load_taxonomy(spark, "saas").orderBy("rule_ord").collect()
    assert table[0].theme == "billing_issue" and table[0].subthemes[0].name == "overcharge"
    assert len(lexicon()["sentiment"]["positive"]) == 15 and len(lexicon()["sentiment"]["negative"]) == 24


def test_record_analysis(spark):
    df = frame(spark, ["Payment failed and money was deducted", None, "hello world", "refund pending"]).withColumn(
        "pii_review_required", F.col("_row_number") == 2)
    rows = an.analyze_rows(df).orderBy("_row_number").collect()
    assert rows[0].primary_theme == "payment_failure" and rows[0].customer_problem.startswith("Detected payment failure related to: ")
    assert rows[0].confidence == round(0.75 * rows[0].primary_confidence + 0.25 * rows[0].sentiment_score, 3)
    assert rows[1].analysis_method == "unknown" and rows[1].analysis_warnings == [fixed.MSG_MASKED_MISSING]
    assert rows[1].severity == "unknown" and rows[1].severity_score == 1.0 and rows[1].intent == "unknown"
    assert rows[2].analysis_warnings == [fixed.MSG_NO_THEME, fixed.MSG_NO_THEME_EVIDENCE, fixed.MSG_PII_REVIEW]
    assert all(r.requires_human_review for r in rows[1:]) and tuple(an.ANALYSIS_COLUMNS) == tuple(an.analyze_rows(df).columns[:20])
    assert an.analysis_totals(an.analyze_rows(df)).first() == (4, 2, 2, 3)
    with pytest.raises(KeyError, match="masked_text"):
        an.analyze_rows(spark.createDataFrame([("1", "raw")], "feedback_id string, feedback_text string"))
    empty = an.analyze_rows(df.where("false"))
    assert an.analysis_warnings(empty) == [fixed.MSG_ANALYSIS_EMPTY]
    assert an.analysis_warnings(an.analyze_rows(df.union(df))) == [fixed.MSG_ANALYSIS_DUPLICATES]


@pytest.mark.parametrize("seed", range(3))
def test_terms_in_one_pass_equal_single_searches(spark, seed):
    rng = random.Random(seed)
    terms = list(dict.fromkeys("".join(rng.choices("ab .?*(\\é", k=rng.randint(1, 5))) for _ in range(60)))
    texts = ["".join(rng.choices("ab .?*(\\éc", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", terms[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", contained_terms(F.col("t"), terms).alias("any"), lexicon_match(F.col("t"), terms).alias("listed")).collect()
    for r in rows:
        expected = [t for t in terms if t in (texts[r.id] or "")]
        assert sorted(r["any"]) == sorted(expected) and r.listed == expected
    assert df.select(lexicon_match(F.col("t"), [])).distinct().collect() == [([],)]
