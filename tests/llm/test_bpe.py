"""Contraction of words of any length against the tokenizer library."""

import random

import public_tokenizers
import pytest

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def piece():
    tiktoken = pytest.importorskip("tiktoken")
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})
    return made._core_bpe.encode_single_piece


def long_words():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = [(s * n).encode() for s in ("a", "ab", "aab", "=-", "é", "哈", "ing", "tion", "\U0001f389", "-", "xyzzy") for n in (33, 70, 333, 2001)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(33, 800))).encode() for _ in range(60)]
    out += ["".join(rng.choice(["a", "b", "aa", "ab", "the", "ing", "哈"]) for _ in range(100)).encode() for _ in range(60)]
    return out + [bytes(rng.randrange(256) for _ in range(rng.randrange(33, 600))) for _ in range(40)]


def test_long_words(codec, piece):
    words = long_words()
    for w, ids in zip(words, codec.contract_long(words), strict=True):
        assert bpe._ids(ids).tolist() == piece(w)


def test_both_queries(codec, piece):
    words = [w[:90] for w in long_words()] + [b"x", "哈".encode(), b"tion"]
    for query in (bpe._ENCODE, bpe._ENCODE_ALL):
        for w, ids in zip(words, codec.contract(words, query), strict=True):
            assert bpe._ids(ids).tolist() == piece(w)


def test_batches_of_any_size(codec, piece, monkeypatch):
    words = long_words()[:40]
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "BYTES", 100)
    assert [bpe._ids(x).tolist() for x in codec.contract_long(words)] == [piece(w) for w in words]


def test_another_pattern(spark):
    """Pieces are cut only where the pattern is the one that they are cut for."""
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"\S+ \S+|\s+|\S+"
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})
    text = "two words and  more of\n them, it is 100 % so"
    row = bpe.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, pattern).first()
    assert [int.from_bytes(row["ids"][k : k + 4], "little") for k in range(0, len(row["ids"]), 4)] == own.encode_ordinary(text)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one", "x", 3), (None, None, "x", 3), (2, "", "x", 3), (1, "one", "x", 3)], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect())
    assert got[:1] == [(0, 0)] and got[3] == (2, 0) and got[1] == got[2]
    assert bpe.digests(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
