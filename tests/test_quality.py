"""Cleaning, validation, duplicates, reports."""

import itertools
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtally.functions.exprs import normalize_text, trim_to_null
from voxtally.functions.values import parse_date, parse_rating, rating_error
from voxtally.operators import quality

SCHEMA = "_row_number long, feedback_id string, feedback_text string, rating string, date string"


def clean(spark, rows):
    checked = quality.checked_rows(spark.createDataFrame(rows, SCHEMA))
    return {r["_row_number"]: r for r in checked.collect()}, checked


def test_status_rules_and_message_order(spark):
    rows, checked = clean(spark, [
        (2, "a", "fine text", "4", "2025-03-01"),
        (3, None, "  ", "9", "soon"),
        (4, "b", "one", "x", None),
        (5, "c", "two", None, "not-a-date"),
    ])
    assert rows[2].row_status == "valid" and rows[2].validation_errors == ""
    assert rows[3].row_status == "error"
    assert rows[3].validation_errors == (
        "feedback_id is empty.; feedback_text is empty or whitespace-only.; "
        "Rating '9' is outside the allowed range 1-5.; Date 'soon' could not be parsed."
    )
    assert rows[4].validation_errors == "Rating 'x' is not numeric."
    assert rows[5].row_status == "warning" and rows[5].date_normalized is None and rows[5].date == "not-a-date"
    assert {r["_row_number"] for r in quality.valid_rows(checked.select(*quality.CLEAN_COLUMNS)).collect()} == {2, 5}


def test_duplicate_interplay(spark):
    rows, checked = clean(spark, [
        (2, "x", "Same text", None, None),
        (3, "x", " same TEXT ", None, None),
        (4, "y", "same text", None, "bad"),
        (5, "z", "same text", "99", None),
        (6, " x ", "other", None, "bad"),
    ])
    both = "Duplicate feedback_text detected.; Duplicate feedback_id detected."
    assert rows[2].validation_errors == both and rows[2].row_status == "error"
    assert rows[3].validation_errors == both
    assert rows[4].row_status == "warning" and rows[4].validation_errors == "Date 'bad' could not be parsed."
    assert rows[5].validation_errors == "Rating '99' is outside the allowed range 1-5."
    assert rows[6].validation_errors == "Date 'bad' could not be parsed.; Duplicate feedback_id detected."
    kinds = sorted((r.row_number, r.issue_type) for r in quality.row_issues(checked).collect())
    assert (4, "duplicate_feedback_text") in kinds and (5, "duplicate_feedback_text") in kinds
    assert [k for k in kinds if k[0] == 6] == [(6, "duplicate_feedback_id"), (6, "invalid_date")]
    report = quality.quality_report(checked, {"id": "feedback_id", "text": "feedback_text"}).first()
    assert (report.total_rows, report.invalid_rows, report.duplicate_id_rows, report.duplicate_text_rows) == (5, 4, 3, 4)
    assert report.missing_optional_columns[0] == "source" and report.missing_required_columns == []
    messages = [r.message for r in quality.quality_messages(quality.row_issues(checked)).collect()]
    assert "Duplicate feedback_id 'x' detected." in messages and len(messages) == len(set(messages))


@pytest.mark.parametrize("make_hot", [0.2, 0.6])
def test_repeats_with_hot_key_match_brute_force(spark, make_hot):
    keys = [None if i % 50 == 7 else "hot" if i % 100 < make_hot * 100 else f"k{i % 37}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(keys)), "n long, feedback_id string")
    got = {r.n: r.duplicate_id for r in quality.flag_duplicate_ids(df).collect()}
    assert got == {i: k is not None and keys.count(k) > 1 for i, k in enumerate(keys)}


def test_ratings_and_dates(spark):
    ratings = {"4": 4.0, " 4.5 ": 4.5, "1e0": 1.0, "0.9": None, "5.01": None, "4d": None, "nan": None, "inf": None, "": None}
    df = spark.createDataFrame([(k,) for k in ratings], "v string")
    rows = df.select("v", parse_rating(F.col("v")).alias("r"), rating_error(F.col("v")).alias("e")).collect()
    assert {r.v: r.r for r in rows} == ratings
    errors = {r.v: r.e for r in rows}
    assert errors["4d"] == "Rating '4d' is not numeric." and errors["nan"] is None and errors[""] is None
    assert errors["inf"] == "Rating 'inf' is outside the allowed range 1-5."
    dates = {
        "2025-03-01": "2025-03-01", "2025-3-1": "2025-03-01", "03/04/2025": "2025-03-04", "13/02/2025": "2025-02-13",
        "2025-03-01 10:11:12": "2025-03-01", "2025-03-01T10:11:12.123Z": "2025-03-01", "5 Mar 2025": "2025-03-05",
        "March 5, 2025": "2025-03-05", "20250305": "2025-03-05", "2025/3/5": "2025-03-05", " 2025-03-01 ": "2025-03-01",
        "2025-03-05 01:30 PM": "2025-03-05", "03/05/2025 1:30 pm": "2025-03-05", "5 Mar 2025, 9 am": "2025-03-05", "3/5/25": "2025-03-05",
        "13/2/98": "1998-02-13", "Wednesday, March 5, 2025": "2025-03-05", "Wed 5 Mar 2025": "2025-03-05", "5th January 2025": "2025-01-05",
        "January 1st, 2025": "2025-01-01", "2nd of March 2025": "2025-03-02", "20250305T101112": "2025-03-05", "20250305101112": "2025-03-05",
        "5-Mar-25": "2025-03-05", "5 March, 2025": "2025-03-05", "2025 Mar 5": "2025-03-05", "2025-03-05 10:11 UTC": "2025-03-05",
        "32nd January 2025": None, "25:00": None,
        "2025-02-30": None, "tomorrow": None, "1500-01-01": None, "2300-01-01": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in dates], "v string")
    got = {r.v: r.d for r in df.select("v", F.date_format(parse_date(F.col("v")), "yyyy-MM-dd").alias("d")).collect()}
    assert got == dates


def test_trim_and_normalise(spark):
    df = spark.createDataFrame([("  a b ",), (" \t\n",), ("　x ",), ("NaN",), (None,)], "v string")
    rows = df.select(trim_to_null(F.col("v")).alias("t"), normalize_text(F.col("v")).alias("n")).collect()
    assert [r.t for r in rows] == ["a b", None, "x", "NaN", None]
    assert [r.n for r in rows] == ["a b", None, "x", None, None]


def test_conformance(spark):
    df = spark.createDataFrame([("a", "x", 3.0), (" ", "x", 9.0), ("b", None, None)], "feedback_id string, feedback_text string, rating double")
    got = {r.constraint_name: (r.rows_checked, r.violations) for r in quality.conformance_report(df, "feedback").collect()}
    assert got == {"feedback_id_filled": (3, 1), "feedback_text_filled": (3, 1), "rating_in_range": (3, 1)}
    assert sorted(quality.violating_rows(df, "feedback").select("violated").collect()) == [
        (["feedback_id_filled", "rating_in_range"],), (["feedback_text_filled"],)]
    labels = spark.createDataFrame(
        [("1", "t", "fees", "Negative", "high", "p"), ("2", "t", "fees", "angry", "urgent", "")],
        "feedback_id string, feedback_text string, expected_theme string, expected_sentiment string, expected_severity string, expected_product_area string")
    bad = {r.constraint_name for r in quality.conformance_report(labels, "evaluation").where("violations > 0").collect()}
    assert bad == {"expected_sentiment_known", "expected_severity_known", "expected_product_area_filled"}
    with pytest.raises(ValueError):
        quality.constraints("nothing")


def test_dates_of_any_shape_as_pandas_reads_them(spark):
    texts = ["2025", "2025-01", "2025-1", "1/2025", "01.2025", "202501051030", "Jan 5", "5 Jan", "12", "2025-13-01", "13/13/2025", "25-1-5", "1/5/25", "5 Jan 25", "Jan 5 '25",
             "2025-01-05T10:00:00+05:30", "Sun Jan  5 10:00:00 2025", "Sun, 05 Jan 2025 10:00:00 GMT", "10:30 Jan 5 2025", "Jan, 2025", "2025 Jan", "7 2025", "hello", "5th of", "1736035200"]
    for y, m, d in itertools.product(("2025", "1999"), ("1", "07", "12"), ("5", "09", "31")):
        texts += [x for s in "-/. " for x in (f"{y}{s}{m}{s}{d}", f"{m}{s}{d}{s}{y}", f"{d}{s}{m}{s}{y}")]
    for y, n, d in itertools.product(("2025", "1999"), ("Jan", "march", "SEPT", "December", "Sep."), ("5", "09", "31")):
        texts += [f"{d} {n} {y}", f"{n} {d}, {y}", f"{d}-{n}-{y}", f"{y} {n} {d}", f"{y}-{n}-{d}", f"{n}-{d}-{y}", f"{d}/{n}/{y}", f"{d}th of {n} {y}", f"{d}. {n} {y}", f"{n} {y}", f"{d}{n}{y}",
                  f"{n} {d} {y} 10:30 PM", f"Monday, {n} {d}, {y}", f"{d} {n} {y} at 10:30", f"{y}, {n} {d}", f"{d},{n},{y}"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        read = {t: pd.to_datetime(t, errors="coerce") for t in texts}
    df = spark.createDataFrame([(t,) for t in read], "v string")
    got = {r.v: r.d for r in df.select("v", F.date_format(parse_date(F.col("v")), "yyyy-MM-dd").alias("d")).collect()}
    assert got == {t: None if pd.isna(d) else d.date().isoformat() for t, d in read.items()}
