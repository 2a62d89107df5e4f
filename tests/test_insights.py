"""Mentions, insights, quotes, priority, explorer and presentation."""

import random

import pytest
from pyspark.sql import functions as F

from voxtally import fixed
from voxtally.operators import decisions as dec
from voxtally.operators import explore, insights, mentions, present, quotes
from voxtally.functions import skew
from voxtally.functions.topics import THEME_TYPE
from voxtally.sources import sinks

AN = f"""_row_number long, feedback_id string, sentiment string, primary_theme string, primary_confidence double, secondary_themes {THEME_TYPE},
  severity string, confidence double, intent string, product_area string, requires_human_review boolean, analysis_method string, cluster_id int"""
FB = "_row_number long, feedback_id string, masked_text string, source string, date string, rating double, user_type string"


def an_row(n, fid, theme="refund_delay", secondary=(), sentiment="negative", severity="high", conf=0.8):
    labels = [(t, "general", 0.6, [], "x", "medium", "keyword_rule") for t in secondary]
    return (n, fid, sentiment, theme, conf, labels, severity, conf, "complaint", "refunds", False, "keyword_rule", None)


def fb_row(n, fid, text, source="email", date="2025-01-01", rating=3.0, user="retail"):
    return (n, fid, text, source, date, rating, user)


def frames(spark, an, fb):
    return spark.createDataFrame(an, AN), spark.createDataFrame(fb, FB)


def test_counts_distributions_trend(spark):
    an, fb = frames(spark, [
        an_row(1, "a", secondary=["fees"]), an_row(2, "b", "fees", conf=0.4), an_row(3, "c", "unknown"), an_row(4, "zz"),
        an_row(5, "d", "refund_delay", secondary=["refund_delay"], sentiment="mixed", severity="critical"),
    ], [
        fb_row(1, "a", "one"), fb_row(2, "b", "two", " ", "01/02/2025", None, None), fb_row(3, "c", "three"),
        fb_row(4, "d", "old", "phone", "2020-01-01", 1.0), fb_row(5, "d", "four", "phone", "bad", 5.0), fb_row(6, "  ", "no id"),
    ])
    agg = insights.aggregate_themes(an, fb)
    rows = {r.theme_name: r for r in agg.insights.collect()}
    assert agg.total == 4 and agg.excluded == 1 and "'zz' excluded" in agg.warnings.first().message
    fees, refund = rows["fees"], rows["refund_delay"]
    assert (fees.primary_count, fees.secondary_count, fees.mention_count, fees.feedback_percentage) == (1, 1, 2, 50.0)
    assert (refund.primary_count, refund.secondary_count, refund.average_rating) == (2, 0, 4.0)  # last row of d counts
    counts = {(r.kind, r.value): r.records for r in agg.distributions.where("theme_name = 'fees'").collect()}
    assert fees.severity_distribution == {"medium": 1, "high": 1} and {k: v for k, v in counts.items() if k[0] == "severity"} == {("severity", "medium"): 1, ("severity", "high"): 1}
    assert {k[1]: v for k, v in counts.items() if k[0] == "source"} == {"email": 1, "unknown": 1}
    assert {k[1]: v for k, v in counts.items() if k[0] == "segment"} == {"retail": 1, "unknown": 1}
    assert {k[1]: v for k, v in counts.items() if k[0] == "day"} == {"2025-01-01": 1, "2025-01-02": 1}
    assert refund.sentiment_distribution == {"negative": 1, "mixed": 1} and refund.date_range == ("2025-01-01", "2025-01-01")
    assert fees.confidence == 0.5 and fees.evidence_strength == "weak" and fixed.MSG_FEW_RECORDS in fees.warnings
    assert refund.possible_root_causes[0] == "Observed evidence: 2 feedback record(s) mention refund delay."
    assert [r.theme_name for r in agg.insights.collect()] == ["fees", "refund_delay"]
    assert {r.feedback_id for r in insights.theme_feedback_ids(agg.mentions).where("theme_name = 'refund_delay'").collect()} == {"a", "d"}
    assert {r.feedback_id for r in mentions.exclude_orphans(an, fb).collect()} == {"a", "b", "c", "d"}
    no_user = insights.aggregate_themes(an, fb.drop("user_type", "rating", "date", "source"))
    assert no_user.distributions.where("kind = 'segment'").isEmpty() and no_user.insights.first().average_rating is None
    with pytest.raises(KeyError, match="masked_text"):
        mentions.feedback_facts(fb.drop("masked_text"))


def test_every_source_is_counted_however_many(spark, tmp_path):
    n = 10_200
    an, fb = frames(spark, [an_row(i, str(i)) for i in range(n)], [fb_row(i, str(i), f"text {i}", f"s{i}") for i in range(n)])
    agg = insights.aggregate_themes(an, fb)
    sources = agg.distributions.where("kind = 'source'")
    assert sources.count() == n and sources.where("records <> 1").isEmpty()
    sinks.export_insights_json(insights.prioritize(agg.insights, agg.total), agg.distributions, insights.theme_feedback_ids(agg.mentions), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/distributions").where("kind = 'source'").count() == n
    assert present.format_distribution(agg.distributions, "source").first().text.count(",") == n - 1


@pytest.mark.parametrize("seed", range(4))
def test_quotes_match_plain_greedy(spark, seed):
    rng = random.Random(seed)
    n = 300
    an_rows, fb_rows = [], []
    for i in range(n):
        theme = rng.choice(["fees", "usability"])
        an_rows.append(an_row(i, f"{i:03}", theme, conf=rng.choice([0.5, 0.6, 0.7])))
        text = rng.choice(["same", "same", "other", f"text {i}", "x" * 221, None])
        fb_rows.append(fb_row(i, f"{i:03}", text, rng.choice(["hot", "hot", "hot", "a", "b", None])))
    an, fb = frames(spark, an_rows, fb_rows)
    got = {r.theme_name: [q.feedback_id for q in r.evidence_quotes] for r in quotes.representative_quotes(mentions.mention_table(an, fb)).collect()}
    for theme in ("fees", "usability"):
        ranked = sorted((-a[7], a[1]) for a in an_rows if a[3] == theme)
        texts, sources, picked = set(), set(), []
        for _, fid in ranked:
            _, _, text, source, *_ = fb_rows[int(fid)]
            source = source or "unknown"
            if len(picked) < 3 and text and len(text) <= 220 and text not in texts and source not in sources:
                picked.append(fid), texts.add(text), sources.add(source)
        assert got[theme] == picked


def test_quote_validation(spark):
    an, fb = frames(spark, [an_row(1, "a")], [fb_row(1, "a", " Refund is still pending. "), fb_row(2, "b", "nan"), fb_row(3, "c", "hello")])
    asked = [("refund_delay", "a", "Refund is still pending."), ("refund_delay", "a", "still"), ("refund_delay", "a", "made up"),
             ("refund_delay", None, "x"), ("refund_delay", "zz", "x"), ("refund_delay", "b", "x"), ("refund_delay", "a", "  "),
             ("fees", "a", "still"), (None, "c", "hello"), ("refund_delay", "c", "hello")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, theme_name string, feedback_id string, quote string")
    for few in (False, True):
        rows = quotes.validate_quotes(df, fb, an, few=few).orderBy("n").collect()
        assert [r.validation_status for r in rows] == ["valid", "valid", "invalid", "missing_feedback_id", "missing_source", "invalid",
                                                       "invalid", "invalid", "valid", "invalid"]
        assert [r.quote_is_exact for r in rows[:2]] == [True, False]
        assert rows[7].validation_message == fixed.MSG_QUOTE_NOT_SUPPORTING and rows[5].validation_message == fixed.MSG_QUOTE_NO_TEXT


def test_revalidation(spark):
    an, fb = frames(spark, [an_row(i, str(i)) for i in range(6)], [fb_row(i, str(i), f"text {i}", f"s{i % 3}") for i in range(6)])
    built = insights.aggregate_themes(an, fb).insights
    assert built.first().evidence_strength == "strong" and len(built.first().evidence_quotes) == 3
    same = quotes.revalidate_insights(built, fb, an).first()
    assert same.evidence_strength == "strong" and same.representative_quotes == built.first().representative_quotes
    lost = quotes.revalidate_insights(built, fb.where("feedback_id > '4'"), an).first()
    assert lost.evidence_strength == "weak" and lost.evidence_quotes == [] and fixed.MSG_QUOTE_NO_SOURCE in lost.warnings
    assert not built.select(insights.insight_pii_flag(built)).first()[0]


def test_priority(spark):
    rows = [("a", 4, {"high": 2, "unknown": 5}, 0.5), ("b", 4, {"low": 4}, 0.5), ("c", 0, {}, 0.9), ("d", 4, {"unknown": 1}, 0.5)]
    df = spark.createDataFrame(rows, "theme_name string, mention_count long, severity_distribution map<string,bigint>, confidence double")
    got = insights.prioritize(df, 8).collect()
    assert [r.theme_name for r in got] == ["a", "b", "d", "c"]
    assert [r.priority_score for r in got] == [0.2, 0.05, 0.0, 0.0]
    assert got[0].priority_components.severity_score == 0.8 and got[0].priority_components.priority_warning == fixed.PRIORITY_WARNING
    assert all(r.priority_score == 0 for r in insights.prioritize(df, 0).collect())


def test_rows_of_one_key_are_split(spark):
    """20 000 rows of one key, and as many without a key, do not stay in one task."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        right = spark.range(200).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
        for hot in (F.lit("k7"), F.lit(None).cast("string")):
            text = F.sha2(F.col("id").cast("string"), 256).alias("text")
            left = spark.range(0, 20_000, 1, 8).select(hot.alias("key"), text).union(spark.range(200).select(F.concat(F.lit("k"), F.col("id")), text))
            joined = skew.lookup_join(left, right, "key").withColumn("task", F.spark_partition_id())
            rows = joined.groupBy("task").agg(F.count(F.lit(1)).alias("count"), F.max("text")).collect()  # the texts give the rows their size
            assert sum(r["count"] for r in rows) == 20_200 and max(r["count"] for r in rows) < 12_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_explorer(spark):
    an, fb = frames(spark, [an_row(1, "a", secondary=["fees", "usability"]), an_row(2, "a"), an_row(3, "q", "unknown")],
                    [fb_row(1, "a", "first text", "email"), fb_row(2, "a", "second", "phone"), fb_row(3, "b", "b")])
    table = explore.explorer_table(an, fb.withColumn("original_text", F.lit("secret")))
    assert tuple(table.columns) == explore.EXPLORER_COLUMNS
    rows = table.collect()
    assert [r.masked_text for r in rows if r.feedback_id == "a"] == ["first text"] * 2
    orphan = [r for r in rows if r.feedback_id == "q"][0]
    assert orphan.masked_text == "" and orphan.source is None and orphan.pii_detected is False
    assert [r.secondary_themes for r in rows if r.secondary_themes] == ["fees, usability"]
    assert explore.filter_explorer(table, primary_themes=["refund_delay"], human_review="No").count() == 2
    assert explore.filter_explorer(table, pii_detected="Yes").count() == 0 and explore.filter_explorer(table).count() == 3
    assert explore.search_explorer(table, " FIRST|unk ").count() == 3 and explore.search_explorer(table, "none").count() == 0
    assert explore.preview(table, 2).count() == 2


def test_presentation(spark):
    an, fb = frames(spark, [an_row(i, str(i), severity="medium", conf=0.3) for i in range(5)],
                    [fb_row(i, str(i), f"text {i}", f"s{i % 2}", rating=3.0) for i in range(5)])
    agg = insights.aggregate_themes(an, fb)
    row = insights.prioritize(agg.insights, agg.total).select(
        present.impact_level().alias("impact"), present.urgency().alias("urgency"), present.theme_label(F.col("theme_name")).alias("label"),
        present.evidence_label(F.col("evidence_strength")).alias("ev"), present.insight_warnings().alias("w"),
        present.short_explanation(F.col("theme_name")).alias("why"), present.status_label(F.lit("needs_more_evidence")).alias("st"),
    ).first()
    assert (row.impact, row.urgency, row.label, row.ev) == ("Medium", "P1 High", "Refund Delay", "Weak")
    assert row.w == [fixed.WARN_WEAK, fixed.WARN_LOW_CONFIDENCE]
    assert present.format_distribution(agg.distributions, "source").first().text == "s0: 3, s1: 2"
    assert present.format_distribution(agg.distributions.where("false"), "source", agg.insights).first().text == "—"
    assert row.why.startswith("Observed evidence") and row.st == "Needs more evidence"
    assert present.overview_stats(agg.insights, agg.total).first() == (5, 1, 0, 0)
    assert present.theme_detail_metrics(agg.mentions).first() == ("refund_delay", 5, 0, "s0")
    assert present.evidence_warning_count(agg.warnings, 2).first()[0] == 2


def test_decision_store(spark, tmp_path):
    store = dec.DecisionStore(spark, str(tmp_path / "log"))
    assert store.get_decision("fees") is None and store.all_decisions().count() == 0 and store.clear_decisions() == 0
    first = store.save_decision(" fees ", "approved", "ok")
    second = store.save_decision("fees", "rejected")
    assert second["created_at"] == first["created_at"] and second["status"] == "rejected" and second["reviewer_note"] == ""
    assert second["updated_at"] > first["updated_at"]
    store.save_decision("usability", "pending", None)
    assert store.delete_decision("fees") and not store.delete_decision("fees")
    assert store.save_decision("fees", "approved")["created_at"] > second["updated_at"]
    with pytest.raises(ValueError):
        store.save_decision("  ")
    with pytest.raises(ValueError):
        store.save_decision("fees", "maybe")
    assert store.clear_decisions() == 2 and store.all_decisions().count() == 0


def test_two_writers_and_compactions_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    one, two = dec.DecisionStore(spark, path), dec.DecisionStore(spark, path)
    one.save_decision("fees", "approved")
    two.save_decision("usability", "rejected")
    events = dec.DecisionStore._events
    turns = []

    def slow(self, folder, files):  # while the first compaction copies, another writer saves and another compaction ends
        found = events(self, folder, files)
        if not turns:
            turns.append(1)
            two.save_decision("fees", "rejected", "late")
            assert two.compact() == 3
        return found

    monkeypatch.setattr(dec.DecisionStore, "_events", slow)
    assert one.compact() == 3  # its own copy of two events came second and does not count
    monkeypatch.undo()
    for store in (one, two, dec.DecisionStore(spark, path)):
        assert {(r.theme_name, r.status) for r in store.all_decisions().collect()} == {("fees", "rejected"), ("usability", "rejected")}
    two.save_decision("security", "pending")
    assert one.compact() == 4 and two.log().count() == 4
    one.save_decision("kyc", "approved")
    assert two.vacuum() == 6 and one.log().count() == 5  # four event files, the first generation and its manifest
    assert one.compact() == 5 and two.vacuum() == 3 and two.log().count() == 5
    (tmp_path / "log" / "_generations" / "00000099.json").write_text('{"folder": ')  # a manifest that is not whole yet
    assert two.log().count() == 5 and {r.theme_name for r in one.all_decisions().collect()} == {"fees", "usability", "security", "kyc"}


def test_a_refused_table_leaves_no_other(spark, tmp_path):
    good = spark.createDataFrame([("fees", 1)], "theme_name string, n int")
    bad = spark.createDataFrame([("fees", "mail me at some.body@mail.example.com")], "theme_name string, feedback_id string")
    path = str(tmp_path / "out")
    write = lambda table, place: sinks.guarded(table).write.json(place)
    with pytest.raises(Exception, match="readable personal data"):
        sinks.publish({"insights": good, "ids": bad}, path, write)
    assert list(tmp_path.iterdir()) == [] and sinks.published(spark, path) == []
    sinks.publish({"insights": good, "ids": good}, path, write)
    assert sinks.published(spark, path) == ["insights", "ids"] and spark.read.json(f"{path}/insights").count() == 1
    with pytest.raises(FileExistsError):
        sinks.publish({"insights": good}, path, write)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_insight_texts_analyses_the_records_once(spark, tmp_path, monkeypatch):
    """Mentions and excluded rows read one written analysis; its plan searches no text."""
    from datetime import datetime

    from workloads import registry

    rows = [(i, i % 7, "click", datetime(2024, 1, 1 + i % 28)) for i in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    read, real = [], insights.aggregate_themes

    def watched(analysis, fb):
        read.append(analysis._jdf.queryExecution().optimizedPlan().toString())
        return real(analysis, fb)

    monkeypatch.setattr(insights, "aggregate_themes", watched)
    found = {r.theme_name: r for r in registry.insight_texts(spark, str(tmp_path)).collect()}
    assert found and all(r.total == 120 and r.excluded == 0 for r in found.values())
    assert len(read) == 1 and "regexp_extract_all" not in read[0]
