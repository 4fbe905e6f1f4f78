import base64
import os

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.bpe import TOKENIZERS, Encoder, PairTable, encode_ids, encoder, token_counts

FOLDER = os.environ.get("TOKENIZERS", TOKENIZERS)


@pytest.fixture(scope="module")
def known():
    import public_tokenizers

    with open(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return encoder("byte_bpe_50k", FOLDER)


PIECES = ["'", "s", "ll", "re", "ve", "t", "'S", " ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "漢", "1", "٣", "!", "''", " ", "　", "\x00", "<|endoftext|>", "ع", "😀", "‍", "\x85", "\x1c", "_", "-", "ǅ", "́", "½", "hello", "return"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=25).map("".join)), max_size=30))
def test_equals_a_known_encoder(known, enc, texts):
    assert enc.encode(pa.array(texts, pa.string())).to_pylist() == [known.encode_ordinary(t or "") for t in texts]


def test_long_words_and_slices(known, enc, monkeypatch):
    texts = ["a" * 3000, "ab" * 4000, " " * 5000, "漢字" * 900, "x" * 20_000, "\n" * 700, None, "", "word " * 2000, "Zürich" * 400]
    want = [known.encode_ordinary(t or "") for t in texts]
    assert enc.encode(pa.array(texts)).to_pylist() == want
    monkeypatch.setattr("millrace.llm.bpe.SLICE", 10)
    assert enc.encode(pa.array(texts)).to_pylist() == want and enc.lengths(pa.array(texts)).tolist() == [len(w) for w in want]


def _thue_morse(k, a, b):
    bits = [0]
    for _ in range(k):
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits)


def test_words_that_collide_under_polynomial_hashes(known, enc):
    texts = [_thue_morse(k, a, b) for k in range(7, 13) for x, y in (("a", "b"), ("é", "x"), ("漢", "字")) for a, b in ((x, y), (y, x))]
    want = [known.encode_ordinary(t) for t in texts]
    assert enc.encode(pa.array(texts)).to_pylist() == want
    assert enc.encode(pa.array(texts[::-1])).to_pylist() == want[::-1]
    assert [enc.encode(pa.array([t])).to_pylist()[0] for t in texts] == want


def test_bytes_decide_where_hashes_are_equal(known, monkeypatch):
    import numpy as np

    monkeypatch.setattr("millrace.llm.bpe._Eights.hashes", lambda self, start, size: (size % 2).astype(np.uint64))
    fresh = Encoder(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"))
    for texts in (["one two three four five", "eno owt"], ["six two", "q" * 600, "q" * 599 + "r", "the brown fox", None], ["seven internationalisation internationalizations"]):
        assert fresh.encode(pa.array(texts)).to_pylist() == [known.encode_ordinary(t or "") for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.sampled_from(["ab", "abc", "etaoinshr", "ABab", "=-_+#/", " \n\t", "漢字éß"]), st.integers(0, 1 << 30), st.integers(513, 6000))
def test_words_beyond_the_matrix(known, enc, letters, seed, n):
    import random

    text = "".join(random.Random(seed).choices(letters, k=n))
    assert enc.encode(pa.array([text])).to_pylist() == [known.encode_ordinary(text)]


def test_memory_starts_afresh(known, monkeypatch):
    monkeypatch.setattr("millrace.llm.bpe.REMEMBERED", 3)
    fresh = Encoder(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"))
    for t in (["one two three four"], ["five six", "one two"], ["seven"]):
        assert fresh.encode(pa.array(t)).to_pylist() == [known.encode_ordinary(x) for x in t]


def test_another_vocabulary(enc):
    path = os.path.join(FOLDER, "byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    texts = ["Über größere Straßen", "ёлка и дом", "plain words"]
    for t, ids in zip(texts, encoder("byte_bpe_multi_50k", FOLDER).encode(pa.array(texts)).to_pylist()):
        assert b"".join(token[i] for i in ids).decode() == t


def test_pair_table_holds_everything():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 5000))
    t = PairTable(keys >> 16, keys & 0xFFFF, np.arange(len(keys)))
    assert (t.get(keys >> 16, keys & 0xFFFF) == np.arange(len(keys))).all()
    assert (t.get(keys >> 16, (keys & 0xFFFF) + (1 << 20)) >= 1 << 40).all()


def test_rows_in_rows_out(spark, known):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "<|endoftext|>"), (4, "x" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS k", "2 AS t", "3 AS ids", "4 AS n")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encode_ids(df, key="doc_id", text="text", folder=FOLDER).collect())
    assert got == sorted((str(k), known.encode_ordinary(t or "")) for k, t in rows)
    n = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(df, key="doc_id", text="text", folder=FOLDER).collect())
    assert n == sorted((k, len(i)) for k, i in got)
    assert encode_ids(df.where("false"), key="doc_id", text="text", folder=FOLDER).count() == 0
