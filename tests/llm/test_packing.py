import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxtally.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(frame, tokenizer):
    truth = []
    for r in frame.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        truth += [(r.doc_id is None, r.doc_id, p, a, len(ids[a: a + 4096]), zlib.crc32(ids[a: a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    rows = packing.pack_documents(frame, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(truth)
    return sequences(rows)


def sequences(rows):
    """The loads of the sequences, after checking that each is without gaps."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= 4096
    return [sum(n for _, n in p) for p in held.values()]


def test_pieces_and_sequences(documents, tokenizer):
    loads = check(documents, tokenizer)
    assert len(loads) <= -(-sum(loads) // 4096) + 1


def test_odd_rows(odd, nothing, tokenizer):
    check(odd, tokenizer)
    assert packing.pack_documents(nothing, PATH).count() == 0


ADDED = ["a <|endoftext|> b", "x<|startoftext|>y.", "<|ENDOFTEXT|>", "<|endoftext|", "The.<|endoftext|>,Then|", "A|<|StartOfText|>. <|endoftext|><|endoftext|>", "Éa<|ENDOFTEXT|>é!", "<|endoftext|>" * 5_000]


def test_words_alone_are_words_in_text(tokenizer):
    words = ["Don't", "stop␞here", "␞", "naïve,", "ét", "́x", "<|endoftext|>", "a<b>", "12.5%", "日本", "x" * 300, "'S", "İSTANBUL", "ΣΑΣ"]
    got = packing.word_ids(PATH, words)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_added_tokens_and_marks(spark, tokenizer):
    texts = [*ADDED, "It's. Its.... its..... IT'S!?;: x. .x .,;:. é. É., a|b a|. |) e\u0301. (x) \"x.\" 1. 2), ", " ".join(ADDED[:-1])]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer)


def test_a_full_word_table_starts_again(spark, tokenizer, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeé.", k=rng.randint(1, 4))) for _ in range(300)) for _ in range(40)]
    monkeypatch.setattr(packing, "CACHE", 50)
    monkeypatch.setattr(packing, "_words", {})
    for k in range(0, 40, 4):
        ids, begins = packing.token_ids(pa.record_batch({"text": texts[k: k + 4]}), PATH)
        for i, text in enumerate(texts[k: k + 4]):
            assert ids[begins[i]: begins[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def fewest(sizes, capacity):
    """The smallest number of bins, by trying."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_fewest_bins():
    rng = random.Random(2)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        true = fewest(sizes, 20)
        lengths, counts = np.unique(sizes, return_counts=True)
        bins, offsets, loads = packing.best_fit(np.array(sizes), 20)
        assert packing.lower_bound(lengths, counts, 20) <= true <= len(loads) <= true + 2
        assert max(loads) <= 20 and sum(loads) == sum(sizes)


def test_bound_sees_more_than_the_sum():
    assert packing.lower_bound(np.array([11]), np.array([7]), 20) == 7  # no two fit one bin
    assert packing.lower_bound(np.array([7]), np.array([9]), 20) == 5  # only two fit one bin


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION", 40)
    rng = random.Random(5)
    cut = spark.createDataFrame([(i, 0, 0, rng.choice([4096, 3000, 2100, 1500, 900, 300, 17]), i) for i in range(1_000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(cut).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1_000))
    loads = sequences(rows)
    lengths, counts = np.unique([r.length for r in rows], return_counts=True)
    monkeypatch.setattr(packing, "ROUNDS", 1)
    alone = sequences(packing.pack(cut).collect())
    assert packing.lower_bound(lengths, counts) <= len(loads) < len(alone)
