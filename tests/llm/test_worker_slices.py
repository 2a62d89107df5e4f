"""How much text a worker holds at once, whatever the size of the Arrow batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from voxtally.llm import langid, packing


class _Docs:
    """Hands back the function that the tasks would run."""

    def __init__(self, spark):
        self.sparkSession = spark
        self.schema = {"kept": spark.createDataFrame([], "kept struct<doc_id: long>").schema["kept"]}
        self.columns = ["doc_id", "text"]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def _batch(rows=3_000):
    texts = pa.array([f"word{i} and some more text, again and again; " * 30 for i in range(rows)])
    ids = pa.array(range(rows), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.StructArray.from_arrays([ids], ["doc_id"]), texts], ["doc_id", "kept", "text"])


def _seen(monkeypatch, module, name):
    sizes, real = [], getattr(module, name)

    def watched(batch, *rest):
        sizes.append(sum(len(t) for t in batch.column("text").to_pylist()))
        return real(batch, *rest)

    monkeypatch.setattr(module, name, watched)
    return sizes


def test_packing_looks_up_a_megabyte_at_a_time(spark, monkeypatch):
    import public_tokenizers

    sizes = _seen(monkeypatch, packing, "token_ids")
    run = packing.pieces(_Docs(spark), public_tokenizers.path("word_bpe_49k.json"))
    out = list(run(iter([_batch()])))
    assert sum(b.num_rows for b in out) == 3_000
    assert max(sizes) <= 1 << 20 and len(sizes) > 3


def test_language_scores_a_quarter_megabyte_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "hello there my friend" if i % 2 else "bonjour mon ami", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    sizes = _seen(monkeypatch, langid, "grams")
    monkeypatch.setattr(langid, "with_kept", lambda given, kept: given)
    out = list(langid.predict(_Docs(spark), model, F.lit(1))(iter([_batch()])))
    assert sum(b.num_rows for b in out) == 3_000
    assert max(sizes) <= 1 << 18 and len(sizes) > 12
