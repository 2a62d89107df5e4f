import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from voxtally.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def check(frame, library, **options):
    truth = sorted((r.doc_id is None, r.doc_id, np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in frame.collect())
    rows = bpe.encode(frame, PATH, PATTERN, **options).collect()
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == truth
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)


def test_equals_the_library_and_comes_back(documents, library):
    check(documents, library)


def test_small_blocks(documents, library):
    check(documents, library, block_bytes=20_000)


def test_odd_rows(odd, nothing, library):
    check(odd, library)
    assert bpe.encode(nothing, PATH, PATTERN).count() == 0


def test_digests(odd, library):
    rows = {r.doc_id: r for r in bpe.encode(odd, PATH, PATTERN, digests=True).collect()}
    text = {r.doc_id: r.text for r in odd.collect()}
    for i in (0, 6, 8):
        ids = library.encode_ordinary(text[i] or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((text[i] or "").encode()).hexdigest()


def test_given_ids_are_decoded_by_the_token_byte_table(spark, library):
    texts = ["one two, été \U0001f600", "", "x" * 2_000, "日本語 " * 50]
    rows = [(i, np.array(library.encode_ordinary(t), "<u4").tobytes(), "decoded") for i, t in enumerate(texts)] + [(9, None, "x"), (9, None, "x")]
    encoded = spark.createDataFrame(rows, "doc_id long, ids binary, decoded string")
    found = [(r.doc_id, r.decoded if r.decoded is None else bytes(r.decoded).decode()) for r in bpe.decode(encoded, PATH).collect()]
    assert sorted(found, key=str) == sorted([*enumerate(texts), (9, None), (9, None)], key=str)
    unknown = spark.createDataFrame([(1, np.array([4_000_000], "<u4").tobytes())], "doc_id long, ids binary")
    with pytest.raises(Exception, match="not in the token-byte table"):
        bpe.decode(unknown, PATH).collect()


def test_decoded_bytes_come_from_the_ids(odd, monkeypatch):
    table = bpe.token_bytes(PATH)
    assert b"".join(table.decode(np.array([i])) for i in range(300)) == table.decode(np.arange(300))
    encoded = bpe.encode(odd, PATH, PATTERN)
    both = encoded.select("doc_id", "ids", "decoded")
    again = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(both, PATH).collect())
    assert again == sorted((str(r.doc_id), bytes(r.decoded)) for r in both.collect())
