"""TF-IDF over the masked texts of a batch, and the theme fallback built on it.

Fitting counts terms with group-bys; vectors are then made row by row with
Spark ML transformers, so no (record, term) pair is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally import fixed
from voxtally.functions import term_batches, topics
from voxtally.functions.exprs import constant, let, normalize_text, settle, strings
from voxtally.session import importable, stage

# Word characters as letters, digits, underscore, plus the Devanagari block inside a word.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\u0900-\u097F]*[\p{L}\p{N}_])?"

#: Hashed buckets that terms are counted by before any is counted exactly; this also bounds the list of buckets that is broadcast.
BUCKETS = 1 << 18
#: Up to this many words in all texts, words and pairs are counted without buckets: there can't be more distinct ones.
DIRECT_WORDS = 20_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bigrams(words: Column) -> Column:
    tail = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), tail), F.slice(words, F.lit(2), tail), lambda a, b: F.concat(a, F.lit(" "), b))


def terms(text: Column) -> Column:
    """Words and word pairs of a text, repeats included; empty for a missing text."""
    return F.coalesce(let(tokens(text), lambda words: F.concat(words, bigrams(words))), strings([]))


@dataclass(frozen=True)
class TfidfModel:
    """Vocabulary (alphabetical) with its inverse document frequencies."""

    vocabulary: tuple[str, ...]
    doc_freq: tuple[int, ...]
    documents: int

    @property
    def idf(self) -> list[float]:
        return [log((1 + self.documents) / (1 + n)) + 1 for n in self.doc_freq]

    def counts(self, df: DataFrame, terms_col: str, out: str) -> DataFrame:
        model = CountVectorizerModel.from_vocabulary(list(self.vocabulary), inputCol=terms_col, outputCol=out)
        return model.transform(df)

    def transform(self, df: DataFrame, terms_col: str, out: str) -> DataFrame:
        """Adds the L2-normalised tf·idf vector of each row."""
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf")
        scaled = weighted.transform(self.counts(df, terms_col, "_tf"))
        return Normalizer(p=2.0, inputCol="_tfidf", outputCol=out).transform(scaled).drop("_tf", "_tfidf")

    def term_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, d, w) for i, (t, d, w) in enumerate(zip(self.vocabulary, self.doc_freq, self.idf))]
        return spark.createDataFrame(rows, "term_index int, term string, doc_freq long, idf double")


MODEL_SCHEMA = "documents long, term_index int, term string, doc_freq long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose write has ended."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    done = [n for n in names if n.startswith("version-") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("version-")) for n in done)


def save_model(spark: SparkSession, model: TfidfModel, path: str) -> int:
    """Write a model (at most as many rows as terms) as the next version under ``path`` and return its number.  Versions are never changed; of two
    writers of the same number the second fails."""
    version = max(_versions(spark, path), default=0) + 1
    rows = [(model.documents, i, t, n) for i, (t, n) in enumerate(zip(model.vocabulary, model.doc_freq))]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.parquet(f"{path}/version-{version}")
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> tuple[TfidfModel, int]:
    """A saved model and its version; the newest whole one, if none is named."""
    known = _versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"There is no {'such version' if known else 'model'} at {path}")
    version = known[-1] if version is None else version
    rows = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/version-{version}").orderBy("term_index").collect()
    return TfidfModel(tuple(r["term"] for r in rows), tuple(r["doc_freq"] for r in rows), rows[0]["documents"]), version


def _counts(rows: DataFrame) -> DataFrame:
    """Occurrences and documents of each term; a row without them stands for one."""
    own = {c: F.lit(1).cast("long") for c in ("n", "docs") if c not in rows.columns}
    return rows.withColumns(own).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def _bucket_totals(rows: DataFrame, label: str) -> DataFrame:
    """Rows of each bucket: sums that tasks and shuffles combine, at most BUCKETS rows whatever the number of terms.  No term is more frequent than its bucket."""
    each = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return stage(rows.groupBy("bucket").agg(each.alias("total")), label)


def _counted(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Exact counts of the terms of some buckets; the others never leave the task that reads them."""
    return _counts(rows.join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi"))


def _floor(counts: DataFrame, size: int) -> int:
    """The count of the ``size``-th term; 0 if there are fewer."""
    found = counts.orderBy(F.desc("n"), "term").limit(size).agg(F.count(F.lit(1)).alias("terms"), F.min("n").alias("least")).first()
    return found.least if found.terms == size else 0


def leading_terms(rows: DataFrame, size: int, label: str) -> DataFrame:
    """The ``size`` most frequent values of ``term`` with their counts, ties by term.

    Terms are first counted by hashed buckets.  The terms of the ``size`` largest buckets are counted exactly, and the ``size``-th of them is a floor: other
    terms can only be among the leading if their whole bucket reaches it.  So what is shuffled does not grow with the number of distinct terms.
    """
    rows = _with_bucket(rows)
    totals = _bucket_totals(rows, f"{label}-buckets")
    largest = stage(totals.orderBy(F.desc("total"), "bucket").limit(size), f"{label}-largest")
    known = stage(_counted(rows, largest), f"{label}-known")
    others = totals.where(F.col("total") >= _floor(known, size)).join(F.broadcast(largest), "bucket", "left_anti")
    counts = known if others.isEmpty() else known.unionByName(_counted(rows, others))
    return counts.orderBy(F.desc("n"), "term").limit(size)


def term_counts(tokenised: DataFrame, size: int = fixed.TFIDF_VOCABULARY, direct: bool = False) -> DataFrame:
    """The ``size`` most frequent words and word pairs of ``words`` arrays, with their counts and the documents that hold them; ties by term.

    A task counts the terms of some texts before anything leaves it. A pair is never more frequent than its first word, and among equals it sorts after it, so a pair
    can only be among the ``size`` if its first word is.  Those words, at most ``size``, are broadcast.  If there are that many, the last one's count is a floor for
    pairs, and only the pairs of buckets that reach it are counted exactly.  With ``direct``, for few words, there are fewer passes; the result is the same.
    """
    context = importable(tokenised.sparkSession).sparkContext
    words = tokenised.select("words").mapInArrow(term_batches.count_words, term_batches.COUNTED)
    best = _counts(words).orderBy(F.desc("n"), "term").limit(size) if direct else leading_terms(words, size, "words")
    leading = stage(best, "leading-words")
    firsts = context.broadcast([row.term for row in leading.select("term").collect()])
    pairs = tokenised.select("words").mapInArrow(term_batches.count_pairs(firsts), term_batches.COUNTED)
    if direct:
        counted = _counts(pairs)
    else:
        pairs = _with_bucket(pairs)
        totals = _bucket_totals(pairs, "pair-buckets")
        counted = _counted(pairs, totals.where(F.col("total") >= _floor(leading, size)))
    return leading.unionByName(counted).orderBy(F.desc("n"), "term").limit(size)


def tfidf_fit(df: DataFrame, column: str = "masked_text", size: int = fixed.TFIDF_VOCABULARY) -> TfidfModel | None:
    """Fit on all non-missing texts; null when there is no term.  At most ``size`` terms reach the driver, and as many leading words."""
    texts = df.select(normalize_text(F.col(column)).alias("text")).where("text is not null")
    tokenised = stage(texts.select(tokens(F.col("text")).alias("words")), "words")  # tokenised once, read by each pass
    total = tokenised.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("words")).alias("words")).first()
    if not total.words:
        return None
    docs = {row.term: row.docs for row in term_counts(tokenised, size, total.words <= DIRECT_WORDS).collect()}
    vocabulary = tuple(sorted(docs))
    return TfidfModel(vocabulary, tuple(docs[t] for t in vocabulary), total.documents)


def with_vectors(df: DataFrame, model: TfidfModel, column: str = "masked_text", out: str = "tfidf") -> DataFrame:
    with_terms = df.withColumn("_terms", terms(normalize_text(F.col(column))))
    return model.transform(with_terms, "_terms", out).drop("_terms")


def vector_entries(vector: Column) -> Column:
    """Non-zero entries of a sparse vector column as array<struct<i, v>>."""
    raw = F.unwrap_udt(vector)
    return F.zip_with(raw["indices"], raw["values"], lambda i, v: F.struct(i.alias("i"), v.alias("v")))


def tfidf_vectors(df: DataFrame, model: TfidfModel, key: str, column: str = "masked_text") -> DataFrame:
    """Long form: one row per (key, term) with its normalised weight."""
    entries = with_vectors(df, model, column).select(key, F.explode(vector_entries(F.col("tfidf"))).alias("e"))
    table = F.broadcast(model.term_table(df.sparkSession).select("term_index", "term"))
    return entries.join(table, F.col("e.i") == F.col("term_index")).select(key, "term", F.col("e.v").alias("weight"))


def theme_reference_docs(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """One text per theme: its phrases, then its keywords."""
    rows = [(i, r["theme"], " ".join([*r["phrases"], *r["keywords"]])) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, theme string, text string")


def theme_similarity(df: DataFrame, model: TfidfModel, rules: Sequence[dict], words_col: str, out: str) -> DataFrame:
    """Adds the cosine similarity to every theme text, as an array in rule order; null where there are no ``words``.

    The theme vectors are a small table that every task holds.
    """
    context = importable(df.sparkSession).sparkContext
    docs = theme_reference_docs(df.sparkSession, rules).select("rule_ord", tokens(F.col("text")).alias("words"))
    texts = {r.rule_ord: r.words for r in docs.collect()}
    held = context.broadcast((model.vocabulary, model.idf, [texts[i] for i in range(len(rules))]))

    @F.arrow_udf("array<double>")
    def similarities(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, idf, texts = held.value
        known, idf = pa.array(vocabulary, pa.string()), np.array(idf)
        firsts = pa.array(sorted({t.split(" ")[0] for t in vocabulary if " " in t}), pa.string())
        themes = np.zeros((len(vocabulary), len(texts)))
        for _, owner, term, weight in term_batches.entries(pa.array(texts, pa.list_(pa.string())), known, firsts, idf):
            themes[term, owner] = weight
        used = themes.any(1)
        for lists in parts:
            found = []
            for count, owner, term, weight in term_batches.entries(lists, known, firsts, idf):
                mine = used[term]
                sums = np.zeros((count, len(texts)))
                np.add.at(sums, owner[mine], themes[term[mine]] * weight[mine, None])
                found.append(sums)
            sums = np.concatenate(found) if found else np.zeros((0, len(texts)))
            none = lists.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(none, 0, len(texts))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(sums[~none].ravel()), mask=pa.array(none))

    return df.withColumn(out, similarities(words_col))


def tfidf_fallback(
    df: DataFrame, model: TfidfModel | None, rules: Sequence[dict], text: Column, hits: Column, needed: Column
) -> DataFrame:
    """Adds ``_fallback``: the most similar theme for rows that need one, else null."""
    empty = F.lit(None).cast("struct<theme:string,similarity:double,subtheme:string,confidence:double,product_area:string,severity:string>")
    if model is None:
        return df.withColumn("_fallback", empty)
    asked = settle(df, _words=F.when(needed, tokens(text)))
    scored = theme_similarity(asked, model, rules, "_words", "_similarity")
    # Rounding makes equal similarities equal, so the first theme wins a tie everywhere.
    rounded = F.transform(F.col("_similarity"), lambda s: F.round(s, 12))
    best = let(rounded, lambda s: F.struct(F.array_max(s).alias("s"), F.array_position(s, F.array_max(s)).alias("at")))
    names = strings([r["theme"] for r in rules])

    def build(b: Column) -> Column:
        theme = F.get(names, (b["at"] - 1).cast("int"))
        chosen = F.struct(
            theme.alias("theme"),
            b["s"].alias("similarity"),
            topics.subtheme(theme, hits, rules).alias("subtheme"),
            F.least(F.lit(fixed.FALLBACK_MAX_CONFIDENCE), b["s"]).alias("confidence"),
            topics.rule_value(theme, rules, "product_area").alias("product_area"),
            topics.severity(hits, topics.rule_value(theme, rules, "default_severity")).alias("severity"),
        )
        return F.when(needed & (b["s"] >= fixed.FALLBACK_MIN_SIMILARITY), chosen)

    return settle(scored.drop("_words"), _fallback=let(best, build)).drop("_similarity")
