"""Language, toxicity and quality: held-out accuracy, and that nothing held out is learned from."""

import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from voxtally.llm import langid, quality, toxicity
from voxtally.llm.tables import fold


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_language_held_out(more_documents):
    truth = {r.doc_id: r.lang for r in more_documents.collect()}
    rows = [r for r in langid.identify(more_documents).collect() if r.held_out]
    assert len(rows) > 250 and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_held_out_labels(documents):
    changed = documents.withColumn("lang", F.when(fold("doc_id", 3) == 1, "xx").otherwise(F.col("lang")))
    assert by_id(langid.identify(documents)) == by_id(langid.identify(changed))


def test_language_odd_rows(odd, nothing, documents):
    rows = langid.identify(odd)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == odd.count()
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 9, None) if i is not None)
    assert langid.identify(nothing).count() == 0
    unlabelled = langid.identify(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and {0, 1, 2, 9}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_grams_by_hand():
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(["ab", None, "é!", "a b"])})
    found, lettered = langid.grams(batch)
    assert [np.diff(begins).tolist() for _, begins in found] == [[2, 0, 1, 2], [1, 0, 1, 2], [0, 0, 0, 1]]
    assert lettered.tolist() == [True, False, True, True]


def plain_grams(text):
    """The buckets of a text's n-grams, one by one."""
    chars = [ord(c) + 1 if c.isalpha() else 0 for c in (text or "").lower()]
    out = []
    for place, n in enumerate(langid.ORDERS):
        for k in range(len(chars) - n + 1):
            if any(chars[k: k + n]):
                h = 0x27D4EB2F * n & 0xFFFFFFFF
                for c, m in zip(chars[k: k + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                    h = (h ^ c) * m & 0xFFFFFFFF
                    h ^= h >> 15
                out.append((place, h >> 16))
    return out


def test_language_equals_plain_naive_bayes_with_300_languages(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzéßñøüąčđęłşžаbвгдежзиклмн"
    own = {f"l{k:03}": rng.sample(letters, 6) for k in range(300)}
    rows = []
    for i in range(1_500):
        lang = f"l{i % 300:03}"
        text = " ".join("".join(rng.choices(own[lang], k=rng.randint(1, 6))) for _ in range(rng.randint(0, 25)))
        rows.append((i, rng.choice([text, text.upper(), text + " 12?"]), lang if i % 11 else None))
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    counts, docs = defaultdict(Counter), Counter()
    for (_, text, lang), out in zip(rows, held):
        if not out and lang:
            counts[lang].update(plain_grams(text))
            docs[lang] += 1
    size = 1 << langid.BITS
    total = {x: [sum(n for (o, _), n in c.items() if o == order) + langid.SMOOTHING * size for order in range(3)] for x, c in counts.items()}
    expected = {}
    for i, text, _ in rows:
        mine = plain_grams(text)
        logs = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((counts[x][g] + langid.SMOOTHING) / total[x][g[0]]) for g in mine) for x in sorted(docs)}
        best = max(logs, key=logs.get)
        expected[i] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())) if mine else ("und", 0.0)
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(docs) > 280 and [r.held_out for r in sorted(found, key=lambda r: r.doc_id)] == held
    assert all(abs(r.score - expected[r.doc_id][1]) < 1e-3 for r in found)
    assert all(r.lang_pred == expected[r.doc_id][0] for r in found if expected[r.doc_id][1] > 0.51 or r.lang_pred == "und")
    truth = {i: lang for i, _, lang in rows}
    sure = [r for r in found if r.held_out and truth[r.doc_id] and r.score > 0.9]
    assert sum(r.lang_pred == truth[r.doc_id] for r in sure) > 0.8 * len(sure) > 0 and len({r.lang_pred for r in found}) > 250


def test_toxicity_held_out(more_documents, labels):
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    rows = [r for r in toxicity.classify(more_documents, labels).collect() if r.held_out and r.doc_id in truth]
    clean, toxic = ([r for r in rows if truth[r.doc_id] == k] for k in (0, 1))
    assert sum(r.predicted == 0 for r in clean) / len(clean) > 0.9
    assert sum(r.score for r in toxic) / len(toxic) > sum(r.score for r in clean) / len(clean) + 0.4


def insults(spark):
    words = "river stone walking garden window letter morning paper silver market".split()
    rows = []
    for i in range(600):
        said = [words[(i * 7 + k * k) % 10] + words[(i + k) % 10][:3] for k in range(12)]
        toxic = i % 4 == 0
        if toxic:
            said[i % 12] = ["idiot", "moron", "worthless"][i % 3]
        rows.append((i, " ".join(said), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_tolerates_gaps_and_inserted_characters(spark):
    table = insults(spark)
    model = toxicity.train(table, table.select("doc_id", "toxic"))
    said = ["river idiot stone", "river i d i o t stone", "river id1iot stone", "river i.d.i.o.t stone", "river IDIOT! stone", "idioot", "worthlesss garden", "walking garden window", "morning market", "", None]
    rows = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string"), model, F.struct("doc_id")).select("kept.doc_id", "predicted", "score")
    assert [r.predicted for r in rows.orderBy("doc_id").collect()] == [1] * 7 + [0] * 4


def test_toxicity_kernel_by_hand():
    """Scores equal a direct sum over the triples of the unit."""
    import numpy as np

    table = np.random.default_rng(1).random(toxicity._TRIPLES).astype(np.float32)
    units = ["ABC", "HAHAHA", "WORD"]
    got = toxicity._project(table, *toxicity._encode(units))
    for unit, value in zip(units, got):
        s = [62, *[ord(c) - 64 for c in unit], 63]
        total = norm = 0.0
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN + 1)):
                    weight = toxicity.DECAY ** (k - i - 2)
                    total += weight * table[s[i] << 12 | s[j] << 6 | s[k]]
                    norm += weight**2
        assert abs(total / norm**0.5 - value) < 1e-4


def test_toxicity_odd_rows(odd, nothing, labels):
    rows = toxicity.classify(odd, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == odd.count()
    assert toxicity.classify(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(odd, labels.where("false")).collect()} == {0}
    assert toxicity.keep_clean(odd, labels.where("false")).columns == odd.columns


def test_quality_held_out(more_documents, labels):
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = [r for r in quality.classify(more_documents, labels).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 60 and sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.9


def test_quality_ignores_held_out_labels(documents, labels):
    changed = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(quality.classify(documents, labels)) == by_id(quality.classify(documents, changed))


def test_quality_features_by_hand():
    import pyarrow as pa

    found, begins = quality.features(pa.record_batch({"text": pa.array(["a b c", None, "a", "A b c"])}))
    n = (begins[1:] - begins[:-1]).tolist()
    assert n == [3 + 2 + 3 + 2 + 1, 0, 2, 11]
    words = lambda i: sorted(found[begins[i]: begins[i + 1]].tolist())
    assert len(set(words(0)) & set(words(3))) >= 5  # the same words, other shapes


def test_quality_odd_rows(odd, nothing, labels):
    rows = quality.classify(odd, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == odd.count()
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
