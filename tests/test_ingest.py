"""CSV files, mapping, row numbers, and the whole flow to the outputs."""

import json

import pytest

from voxtally import fixed
from voxtally.operators import analysis as an
from voxtally.operators import insights, privacy, quality
from voxtally.plans import pipeline
from voxtally.sources import feedback_csv as csv
from voxtally.sources import mapping, sinks
from voxtally.streaming import stream

HEADER = "Ticket ID,Comment,channel,created-at,stars,notes\n"
BODY = (
    '1,"Payment failed and money was deducted, mail a@b.co",email,2025-01-05,1,x\n'
    '2,"Refund is still pending\nafter ""12"" days",phone,01/06/2025,2,y\n'
    "3,Refund pending for weeks,email,someday,2,\n"
    "4,Refund pending again,in_app,2025-01-07,9,\n"
    "5,,email,2025-01-08,3,\n"
    "6,Great app,NA,2025-01-09,5,\n"
    "6,Great app,chat,2025-01-09,5,\n"
    "7,The app crashes whenever I open it,chat,2025-01-10,1,\n"
)


def write(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_whole_ingest(spark, tmp_path):
    path = write(tmp_path, "feedback.csv", b"\xef\xbb\xbf" + (HEADER + BODY).encode())
    got = csv.load_and_validate(spark, path, max_bytes=fixed.MAX_CSV_BYTES)
    rows = {r["_row_number"]: r for r in got.all_rows.collect()}
    assert sorted(rows) == list(range(2, 10)) and tuple(got.all_rows.columns) == quality.CLEAN_COLUMNS
    assert rows[3].feedback_text == 'Refund is still pending\nafter "12" days' and rows[3].date_normalized == "2025-01-06"
    assert [rows[n].row_status for n in range(2, 10)] == ["valid", "valid", "warning", "error", "error", "error", "error", "valid"]
    assert rows[7].source is None and got.valid_rows.count() == 4
    report = got.report.first()
    assert (report.total_rows, report.valid_rows, report.duplicate_id_rows, report.invalid_rating_rows) == (8, 4, 2, 1)
    assert report.source_name == "feedback.csv" and report.detected_encoding == "utf-8" and report.file_size_bytes > 100
    assert report.missing_optional_columns == ["user_type", "region", "product_area", "language"]
    assert report.detected_columns == ["ticket_id", "comment", "channel", "created_at", "stars", "notes"]
    assert got.mapping == {"ticket_id": "feedback_id", "comment": "feedback_text", "channel": "source", "created_at": "date", "stars": "rating"}


@pytest.mark.parametrize("name, data, error", [
    ("empty.csv", b"", csv.EmptyFileError),
    ("header.csv", b"id,text\n", csv.EmptyFileError),
    ("data.txt", b"id,text\n1,a\n", csv.InvalidFileTypeError),
    ("latin.csv", "id,text\n1,café\n".encode("latin-1"), csv.EncodingError),
    ("wide.csv", b"id,text\n1,a,b,c\n", csv.MalformedCsvError),
    ("none.csv", b"a,b\n1,2\n", mapping.MissingColumnError),
    ("two.csv", b"id,text,comment\n1,a,b\n", mapping.AmbiguousMappingError),
])
def test_unusable_files(spark, tmp_path, name, data, error):
    with pytest.raises(error):
        csv.load_and_validate(spark, write(tmp_path, name, data))


def test_size_gate_and_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.read_feedback_csv(spark, str(tmp_path / "absent.csv"))
    path = write(tmp_path, "a.csv", "id,text\n1,hello\n")
    with pytest.raises(csv.FileTooLargeError):
        csv.read_feedback_csv(spark, path, max_bytes=5)
    assert csv.read_feedback_csv(spark, path).rows.count() == 1


def test_row_numbers_over_files_and_splits(spark, tmp_path):
    for f in range(3):
        lines = "".join(f"{f}-{i},text {i} {'x' * (i % 40)}\n" for i in range(2000))
        write(tmp_path, f"part{f}.csv", "id,text\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = csv.read_feedback_csv(spark, str(tmp_path), multiline=False).rows.select("id", "_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 6000 and all(r["_row_number"] == int(r.id.split("-")[1]) + 2 for r in rows)


def test_mapping_rules(spark):
    df = spark.createDataFrame([("1", "a", "x")], ["Ticket-ID", " Comment ", "Other"])
    assert mapping.map_columns(df).columns == ["feedback_id", "feedback_text"]
    assert mapping.map_columns(df, {"other": "feedback_text", "ticket_id": "feedback_id"}).first() == ("1", "x")
    for wrong, error in (({"nope": "feedback_id"}, mapping.MissingColumnError), ({"other": "feedback_id"}, mapping.MissingColumnError),
                         ({"ticket_id": "feedback_id", "comment": "feedback_text", "other": "mood"}, mapping.MappingError),
                         ({"ticket_id": "feedback_id", "comment": "feedback_text", "other": "feedback_text"}, mapping.AmbiguousMappingError)):
        with pytest.raises(error):
            mapping.map_columns(df, wrong)
    twice = spark.createDataFrame([("1", "2")], ["a b", "a-b"])
    with pytest.raises(mapping.MappingError, match="become equal"):
        mapping.normalize_columns(twice)
    both, message = mapping.try_infer_mapping(spark.createDataFrame([("1", "2")], ["id", "ticket_id"]))
    assert both is None and "feedback_id" in message


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    got = csv.load_and_validate(spark, write(folder, "feedback.csv", HEADER + BODY))
    return pipeline.run_pipeline(pipeline.mask(got.valid_rows))


def test_pipeline(spark, run):
    assert "feedback_text" not in run.masked.columns and "original_text" not in run.masked.columns
    ranked = run.ranked.collect()
    assert {r.theme_name for r in ranked} == {"payment_failure", "refund_delay", "app_performance"}
    scores = [r.priority_score for r in ranked]
    assert scores == sorted(scores, reverse=True) and run.aggregation.total == 4 and run.aggregation.excluded == 0
    assert all(r.mention_count == r.primary_count + r.secondary_count and 0 <= r.feedback_percentage <= 100 for r in ranked)
    assert run.explorer.count() == 4 and run.clusters.k == 4
    labelled = pipeline.with_clusters(run.analysis, run.clusters)
    assert labelled.columns == run.analysis.columns and labelled.where("cluster_id is null").count() == 0
    with pytest.raises(KeyError):
        pipeline.run_pipeline(run.masked.drop("masked_text"))


def test_outputs(spark, run, tmp_path):
    decisions = spark.createDataFrame([("refund_delay", "approved", "call them")], "theme_name string, status string, reviewer_note string")
    sinks.export_records_csv(run.analysis, run.masked, str(tmp_path / "records"), decisions)
    records = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "records"))
    assert len(records.columns) == 19 and records.where("review_status = 'approved'").count() == 2
    sinks.export_insights_csv(run.ranked, str(tmp_path / "insights"), decisions)
    assert len(spark.read.csv(str(tmp_path / "insights"), header=True).columns) == 16
    ids = insights.theme_feedback_ids(run.aggregation.mentions)
    sinks.export_insights_json(run.ranked, run.aggregation.distributions, ids, str(tmp_path / "json"), decisions, "now")
    documents = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json" / "insights")).collect()]
    assert documents[0]["priority_components"]["priority_method"] == fixed.PRIORITY_METHOD and "severity_distribution" in documents[0]
    assert spark.read.json(str(tmp_path / "json" / "meta")).first().total_themes == 3
    assert spark.read.json(str(tmp_path / "json" / "source_feedback_ids")).count() == ids.count()
    sinks.export_report_md(str(tmp_path / "report"), run.ranked, ids, 4, 4, decisions, "now")
    parts = sorted((tmp_path / "report").glob("part-*"))
    lines = "".join(p.read_text("utf-8") for p in parts).split("\n")
    assert lines[0].startswith("# Voice-of-Customer") and "### Payment Failure" in lines and "- **Reviewer Note:** call them" in lines
    assert lines.index("## Dataset Summary") < lines.index("## Detailed Theme Breakdown") < lines.index("## Privacy Statement")
    assert not any("a@b.co" in line for line in lines) and any("[EMAIL_REDACTED]" in line for line in lines)
    with pytest.raises(Exception, match="personal data of type PHONE|personal data of type EMAIL"):
        bad = spark.createDataFrame([("fees", "approved", "call 9876543210"), ("refund_delay", "approved", "mail x@y.org")], decisions.schema)
        sinks.export_insights_csv(run.ranked, str(tmp_path / "bad"), bad)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, str(i), t, f"2025-01-0{1 + i % 9}", "3") for i, t in enumerate(["refund pending a@b.co", "app crashes", "  ", "Great app"] * 5)]
    df = spark.createDataFrame(rows, "_row_number long, feedback_id string, feedback_text string, date string, rating string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    source = stream.read_feedback_stream(spark, str(tmp_path / "in"), df.schema, "*.parquet", files_per_trigger=1)
    cleaned = stream.clean_stream(source)
    query = stream.write_stream(stream.analyze_stream(cleaned), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    batch = an.analyze_rows(privacy.safe_columns(privacy.mask_feedback(quality.valid_rows(quality.row_status(df)))))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count() == 15


def test_short_rows_are_kept_and_surplus_fields_are_not(spark, tmp_path):
    short = 'id,text,rating\n1,hello,4\n2,world\n3,"one, two",\n4\n'
    got = csv.load_and_validate(spark, write(tmp_path, "short.csv", short))
    rows = {r["_row_number"]: r for r in got.all_rows.collect()}
    assert [(rows[n].feedback_id, rows[n].feedback_text, rows[n].rating) for n in range(2, 6)] == [("1", "hello", 4.0), ("2", "world", None), ("3", "one, two", None), ("4", None, None)]
    assert [rows[n].row_status for n in range(2, 6)] == ["valid", "valid", "valid", "error"]
    for name, text in (("wide.csv", 'id,text\n1,"a,b"\n2,a,b\n'), ("lines.csv", 'id,text\n1,"a\nb"\n2,"a\nb",c\n')):
        with pytest.raises(csv.MalformedCsvError, match="Row 3"):
            csv.load_and_validate(spark, write(tmp_path, name, text))


def test_files_are_split_unless_a_field_has_a_line_break(spark, tmp_path):
    plain = write(tmp_path, "plain.csv", "id,text\n" + "".join(f'{i},"text, ""{i}"" {"x" * 30}"\n' for i in range(3000)))
    broken = write(tmp_path, "broken.csv", "id,text\n" + "".join(f'{i},"text\n{i} {"x" * 30}"\n' for i in range(3000)))
    assert csv.line_facts(spark, plain).open_quotes == 0 and csv.line_facts(spark, broken).open_quotes == 6000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for path in (plain, broken):
            rows = csv.read_feedback_csv(spark, path).rows.select("id", "_row_number").collect()
            assert sorted((int(r.id), r["_row_number"]) for r in rows) == [(i, i + 2) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_few_scans_of_the_file(spark, tmp_path):
    got = csv.load_and_validate(spark, write(tmp_path, "feedback.csv", HEADER + BODY))
    for table in (got.all_rows, got.report, got.issues, got.messages):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan and plan.count("FileScan parquet") == 1


def test_parquet_rows_are_numbered_in_one_pass(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = csv.number_parquet_rows(spark.read.parquet(str(tmp_path / "t")).select("id", "_metadata"))
    assert all(r["_row_number"] == r.id + 2 for r in rows.collect())


def test_staged_tables_can_be_dropped(spark, tmp_path):
    from pathlib import Path

    from voxtally.session import build_session, drop_staged, new_folder, stage

    assert stage(spark.range(3), "three").count() == 3
    folder = Path(new_folder(spark, "x").removeprefix("file:")).parent
    kept = spark.newSession()
    assert folder.exists() and build_session().sparkContext.applicationId in str(folder)
    other = folder.parent / "another-application"
    other.mkdir(exist_ok=True)
    drop_staged(kept)
    assert not folder.exists() and other.exists()
