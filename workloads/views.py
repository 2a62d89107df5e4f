"""Feedback views over the given tables, each as a Spark DataFrame and as the same view in SQL.

``docs``    feedback made of ``documents`` (real text lengths, copies, personal data)
``raw``     untidy feedback made of ``events``: blank and repeated ids, bad ratings and dates
``masked``  tidy feedback made of ``events`` that analysis operators take as already masked
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.sources.tables import read_table

# Own sentences, picked by event number.  {u} user, {e} event, {p} eight digits, {c} four digits.
SENTENCES = (
    "Payment failed and money was deducted twice for order {e}.",
    "Refund is still pending after 12 days, waiting for refund since order {e}.",
    "KYC rejected without reason and document upload failed again.",
    "Unable to login since morning, account blocked for user {u}.",
    "OTP not received on my phone and otp delayed every time.",
    "Duplicate charge and missing transaction in my statement.",
    "Hidden charges and annual fee without prior notification, very bad.",
    "Customer support kept me on hold for an hour, generic replies only.",
    "App crashes whenever I open it and the app is slow to load.",
    "Too many steps and labels are unclear, navigation menu is confusing.",
    "Fraud alert: I did not authorize this, unknown device in my account.",
    "Please add dark mode and export to csv, would like both.",
    "Great app, easy and smooth, love the new design.",
    "Thank you, the support team was helpful and resolved my issue {e}.",
    "How do I change my address?",
    "What is the limit for user {u}?",
    "Everything is fine.",
    "   ",
    None,
    "nan",
    "Contact me at user{u}@mail.example.com about the payment failed yesterday.",
    "Call +91 98{p} because refund pending, I am unable to wait.",
    "My card 4111 1111 1111 {c} was charged a service fee.",
    "Send it to user{u}@upi please, transaction pending for days.",
    "Aadhaar 1234 5678 {c} upload keeps failing, kyc pending.",
    "Account number 00012345{p} is locked out, login blocked.",
    "PAN ABCDE{c}F shows verification problem and identity verification error.",
    "Reference TXN{p}AB for the failed payment, gateway timeout.",
    "Bahut der ho gayi, refund nahi aaya, service खराब hai.",
    "achha app, अच्छा design, आसान to use, fast.",
    "Payment failed, refund pending and app crashes: worst day, terrible.",
    "The unhelpful agent could not resolve it, refund still pending.",
    "App freezes on splash and there is battery drain on build {e}.",
    "Session stays active after logout, security settings are confusing.",
    "otp help needed with the verification code",
    "slow waiting for the app to load on my device {u}",
    "money and payment problems with the merchant again {u}",
    "Refund not credited. I have written to the team many times about order {e} and every answer is the same: "
    "please wait a little longer, the refund is being looked at by another team, and nobody can tell me when "
    "the money will be back on my side or why it takes so long.",
    "  Dashboard is slow, invoice overcharged twice \n and the refund pending  ",
)
#: Tables of fewer bytes are dealt out over all cores.
SMALL_BYTES = 256 << 20
CITIES = ("Mumbai", "Delhi", "Bengaluru", "Chennai")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table.  Small tables are files of one row group, which no split size can divide: those are dealt out."""
    df = read_table(spark, f"{sf_dir}/{name}.parquet")
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES
    return df.repartition(min(16, spark.sparkContext.defaultParallelism)) if small else df


def _sentence() -> Column:
    e, u = F.col("event_id"), F.col("user_id")
    number = (e % len(SENTENCES)).cast("int")
    text = F.get(F.array(*[F.lit(s) for s in SENTENCES]), number)
    for mark, value in (
        ("{u}", u.cast("string")),
        ("{e}", e.cast("string")),
        ("{p}", F.lpad(e.cast("string"), 8, "0")),
        ("{c}", F.lpad((e % 10000).cast("string"), 4, "0")),
    ):
        text = F.replace(text, F.lit(mark), value)
    return text


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from(table(spark, sf_dir, "events"))


def raw_from(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    day = (
        F.when(e % 23 == 4, "not-a-date")
        .when(e % 23 == 7, F.date_format("ts", "MM/dd/yyyy"))
        .when(e % 23 == 9, F.lit(None))
        .when(e % 23 == 11, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    rating = (
        F.when(e % 41 == 8, "five").when(e % 43 == 2, F.lit(None)).when(e % 47 == 1, " 4.5 ").otherwise((e % 7).cast("string"))
    )
    return events.select(
        (e + 2).alias("_row_number"),
        F.when(e % 97 == 5, "  ").when(e % 89 == 3, (e - 1).cast("string")).otherwise(e.cast("string")).alias("feedback_id"),
        _sentence().alias("feedback_text"),
        F.col("event_type").alias("source"),
        day.alias("date"),
        rating.alias("rating"),
        F.when(u % 3 == 0, "retail").when(u % 3 == 1, " SME ").alias("user_type"),
        F.get(F.array(*[F.lit(c) for c in CITIES]), (u % 4).cast("int")).alias("region"),
        F.lit("English").alias("language"),
        *extra,
    )


RAW_SQL = """
raw AS (
  SELECT event_id + 2 AS _row_number,
    CASE WHEN event_id % 97 = 5 THEN '  ' WHEN event_id % 89 = 3 THEN CAST(event_id - 1 AS VARCHAR)
         ELSE CAST(event_id AS VARCHAR) END AS feedback_id,
    replace(replace(replace(replace(({sentences})[CAST(event_id % {n} AS INT) + 1], '{{u}}', CAST(user_id AS VARCHAR)),
      '{{e}}', CAST(event_id AS VARCHAR)), '{{p}}', lpad(CAST(event_id AS VARCHAR), 8, '0')),
      '{{c}}', lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')) AS feedback_text,
    event_type AS source,
    CASE WHEN event_id % 23 = 4 THEN 'not-a-date' WHEN event_id % 23 = 7 THEN strftime(ts, '%m/%d/%Y')
         WHEN event_id % 23 = 9 THEN NULL WHEN event_id % 23 = 11 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         ELSE strftime(ts, '%Y-%m-%d') END AS date,
    CASE WHEN event_id % 41 = 8 THEN 'five' WHEN event_id % 43 = 2 THEN NULL WHEN event_id % 47 = 1 THEN ' 4.5 '
         ELSE CAST(event_id % 7 AS VARCHAR) END AS rating,
    CASE WHEN user_id % 3 = 0 THEN 'retail' WHEN user_id % 3 = 1 THEN ' SME ' END AS user_type,
    ({cities})[CAST(user_id % 4 AS INT) + 1] AS region,
    'English' AS language
  FROM events)"""


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def raw_sql() -> str:
    return RAW_SQL.format(sentences=sql_list(SENTENCES), n=len(SENTENCES), cities=sql_list(CITIES)).strip()


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its own number as id; ratings outside 1..5 are null."""
    rows = raw(spark, sf_dir)
    number = F.col("rating").try_cast("double")
    return rows.select(
        "_row_number",
        (F.col("_row_number") - 2).cast("string").alias("feedback_id"),
        F.col("feedback_text").alias("masked_text"),
        "source",
        "date",
        F.when(number.between(1, 5), number).alias("rating"),
        F.trim("user_type").alias("user_type"),
        (F.col("_row_number") % 11 == 0).alias("pii_review_required"),
        (F.col("_row_number") % 5 == 0).alias("pii_detected"),
    )


def masked_sql() -> str:
    return raw_sql() + """,
masked AS (
  SELECT _row_number, CAST(_row_number - 2 AS VARCHAR) AS feedback_id, feedback_text AS masked_text, source, date,
    CASE WHEN TRY_CAST(trim(rating) AS DOUBLE) BETWEEN 1 AND 5 THEN TRY_CAST(trim(rating) AS DOUBLE) END AS rating,
    trim(user_type) AS user_type, _row_number % 11 = 0 AS pii_review_required, _row_number % 5 = 0 AS pii_detected
  FROM raw)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 2).alias("_row_number"),
        F.col("doc_id").cast("string").alias("feedback_id"),
        F.col("text").alias("feedback_text"),
        "source",
        F.col("lang").alias("language"),
    )


DOCS_SQL = """docs AS (
  SELECT doc_id + 2 AS _row_number, CAST(doc_id AS VARCHAR) AS feedback_id, text AS feedback_text, source, lang AS language
  FROM documents)"""
