"""Masking against a plain-Python reading of the same patterns."""

import random
import re

import pytest

from voxtally import fixed
from voxtally.operators import privacy
from voxtally.sources import sinks

CASES = {
    "mail me at bob.smith+x@example.co.in now": "mail me at [EMAIL_REDACTED] now",
    "call +91 9876543210 or 09876543210.": "call [PHONE_REDACTED] or [PHONE_REDACTED].",
    "UPI ID: name@upi please": "UPI ID: [UPI_REDACTED] please",
    "user@upi.com": "[UPI_REDACTED].com",
    "aadhaar: 1234 5678 9012": "aadhaar: [AADHAAR_REDACTED]",
    "number 1234-5678-9012 here": "number [AADHAAR_REDACTED] here",
    "account number 123456789012": "account number [ACCOUNT_REDACTED]",
    "card ending 4111 1111 1111 1111": "card ending [CARD_REDACTED]",
    "4111-1111-1111-1111": "4111-[AADHAAR_REDACTED]",
    "PAN ABCDE1234F": "PAN [PAN_REDACTED]",
    "TXN12345678 failed": "TXN[TRANSACTION_ID_REDACTED] failed",
    "REF-2024-00012": "REF-[TRANSACTION_ID_REDACTED]",
    "transaction pending": "transaction [TRANSACTION_ID_REDACTED]",
    "nothing to see": "nothing to see",
}


def brute_force(text):
    """The same patterns with Python's engine and a plain loop."""
    if text is None or not text.strip() or text.strip().lower() == "nan":
        return "", []
    spans = []
    for kind, flags, before, span, after, priority, _ in fixed.PII_PATTERNS:
        for m in re.finditer(f"({before})({span}){after}", text, re.I if flags else 0):
            spans.append((priority, m.start(2), -(m.end(2) - m.start(2)), m.end(2), kind))
    kept = []
    for s in sorted(spans):
        if all(s[3] <= k[1] or s[1] >= k[3] for k in kept):
            kept.append(s)
    kept.sort(key=lambda s: s[1])
    out, at = "", 0
    for s in kept:
        out, at = out + text[at:s[1]] + f"[{s[4]}_REDACTED]", s[3]
    return out + text[at:], kept


def test_fixed_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "feedback_text string")
    got = {r.feedback_text: r.masked_text for r in privacy.mask_pii(df).collect()}
    for text, masked in CASES.items():
        assert brute_force(text)[0] == got[text]
        assert got[text] == masked


def test_random_texts_match_brute_force(spark):
    rng = random.Random(7)
    parts = [*CASES, "9876543210", "+91", "12345678", "a@b.co", "x@upi", "é", "नमस्ते", "﷐", "ref", "card ", "  ", "-", "5", "ABCDE1234F", "@", "Transaction ID: AB-12345"]
    texts = [rng.choice(["", " ", ", "]).join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, feedback_text string")
    for row in privacy.detect_pii(df).collect():
        masked, kept = brute_force(row.feedback_text)
        assert row.masked_text == masked, row.feedback_text
        assert [(e["start"], e["end"], e["entity_type"]) for e in row.entities] == [(k[1], k[3], k[4]) for k in kept]
        assert all(e["end"] - e["start"] == e["original_length"] for e in row.entities)
        assert row.pii_entity_types == sorted({k[4] for k in kept})


def test_missing_and_review_flags(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("nan",), ("ABCDE1234F",), ("PAN ABCDE1234F",), ("a@b.co 9876543210",)], "feedback_text string")
    rows = privacy.detect_pii(df).collect()
    assert [r.masked_text for r in rows[:3]] == ["", "", ""] and not any(r.pii_detected for r in rows[:3])
    assert rows[0].original_text is None and rows[1].original_text == "" and rows[0].pii_warning == fixed.MSG_PII_MISSING
    assert [r.pii_review_required for r in rows] == [False, False, False, True, False, True]
    masked = privacy.mask_feedback(df)
    assert privacy.pii_summary(masked).first() == (6, 3, 2)
    assert [tuple(r) for r in privacy.pii_type_counts(masked).collect()] == [("EMAIL", 1), ("PAN", 2), ("PHONE", 1)]
    with pytest.raises(KeyError):
        privacy.mask_feedback(df, "absent")
    assert "original_text" not in privacy.safe_columns(masked).columns


def test_gate_rejects_nested_values_and_raw_columns(spark):
    bad = spark.createDataFrame([(1, [("x", {"k": "call 9876543210"})])], "n int, a array<struct<t:string,m:map<string,string>>>")
    with pytest.raises(sinks.ExportPrivacyError, match="PHONE"):
        sinks.privacy_gate(bad)
    with pytest.raises(sinks.ExportPrivacyError, match="raw-text column"):
        sinks.privacy_gate(spark.createDataFrame([("x",)], "original_text string"))
    keyed = spark.createDataFrame([({"original_text": "x"},)], "m map<string,string>")
    with pytest.raises(sinks.ExportPrivacyError, match="as a key"):
        sinks.privacy_gate(keyed)
    with pytest.raises(Exception, match="as a key"):
        sinks.guarded(keyed).collect()
    with pytest.raises(sinks.ExportPrivacyError, match="EMAIL"):
        sinks.privacy_gate(spark.createDataFrame([({"a@b.co": [1]},)], "m map<string,array<int>>"))
    good = spark.createDataFrame([("[PHONE_REDACTED] ok", 9876543210)], "t string, n long")
    assert sinks.privacy_gate(good).count() == 1


def test_guarded_write_commits_nothing(spark, tmp_path):
    df = spark.createDataFrame([("fine",), ("mail a@b.co",)], "t string")
    with pytest.raises(Exception, match="personal data of type EMAIL"):
        sinks.write_csv(df, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def test_masking_is_stable_on_its_output(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "feedback_text string")
    once = privacy.mask_pii(df).selectExpr("masked_text AS feedback_text")
    assert all(row.rows == 0 for row in sinks.privacy_findings(once.withColumnRenamed("feedback_text", "t")).collect())


def test_very_many_matches_in_one_text(spark):
    """Offsets, resolution and masking stay in proportion to the text."""
    import time

    text = " ".join(f"mail user{i}@example.com or 98{i:08}" for i in range(6_000))
    df = spark.createDataFrame([(text,)], "feedback_text string")
    start = time.time()
    row = privacy.detect_pii(df).first()
    assert time.time() - start < 60 and len(row.entities) == 12_000
    assert row.masked_text == " ".join("mail [EMAIL_REDACTED] or [PHONE_REDACTED]" for _ in range(6_000))
