"""Merge replay against an independent encoder, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from frames import COLUMNS, collected, empty, frame, odd_documents

from cohortdeck.llm import bpe
from cohortdeck.llm.queries import QUERIES
from cohortdeck.llm.tokens import split_pattern, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=split_pattern(), mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


def coded(spark, rows, **bounds):
    df = frame(spark, rows, extra=True)
    return bpe.decode(bpe.encode(df, PATH, split_pattern(), **bounds), PATH)


@pytest.mark.parametrize("bounds", [{}, {"most_words": 50}, {"most_letters": 40}])
def test_odd_documents(spark, plain, bounds):
    found = coded(spark, odd_documents(), **bounds)
    rows = collected(found, "doc_id", "ids", "decoded", "n", "a b")
    expected = [(r[0], plain.encode_ordinary(r[1] or ""), (r[1] or "").encode(), 7, "7") for r in odd_documents()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    assert "text" not in found.columns


def test_unusual_letters(spark, plain):
    texts = [f"a{c}b {c}{c} 1{c}2" for c in map(chr, [*range(0x700), *range(0x2000, 0x2100), 0x3000, 0x4E2D, 0x1F600, 0x10FFFF])]
    rows = collected(coded(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), "doc_id", "ids", "decoded")
    assert sorted((k, ids, bytes(d)) for k, ids, d in rows) == [(k, plain.encode_ordinary(t), t.encode()) for k, t in enumerate(texts)]


@pytest.mark.parametrize("letter", [" ", "\n", "a", "\t ", "é"])
def test_very_long_words(spark, letter):
    text = letter * 2_000_000
    ((n, decoded),) = coded(spark, [(1, text, None, None, None)]).selectExpr("size(ids)", "decoded").collect()
    assert bytes(decoded) == text.encode() and n > 0


def test_blanks_of_all_kinds(spark, plain):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice([" ", " ", "a", "b.", "'s", "'", "1", "\n", "\t", "\x1c", "\x85", "\xa0", "x" * 150]) for _ in range(80)) for _ in range(400)]
    rows = collected(coded(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), "doc_id", "ids", "decoded")
    assert sorted((k, ids, bytes(d)) for k, ids, d in rows) == [(k, plain.encode_ordinary(t), t.encode()) for k, t in enumerate(texts)]


def test_any_order_of_ranks():
    """Vocabularies whose merges can make pairs of lower rank than their own."""
    rnd = random.Random(5)
    for _ in range(60):
        tokens = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(60)})
        rnd.shuffle(tokens)
        vocab = bpe.Vocabulary.__new__(bpe.Vocabulary)
        vocab.set_ranks({bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(tokens)})
        other = tiktoken.Encoding("other", pat_str=r"[^ ]+", mergeable_ranks=vocab.ranks, special_tokens={})
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(6, 60))) for _ in range(300)]
        ids, counts = bpe.replay([w.encode() for w in words], vocab)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [other.encode_ordinary(w) for w in words]


def test_empty_table_and_replaced_columns(spark):
    assert bpe.decode(bpe.encode(empty(spark), PATH, split_pattern()), PATH).collect() == []
    df = spark.createDataFrame([(1, "one two", "x", "y", 1)], COLUMNS).selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded")
    (row,) = bpe.round_trip(df, PATH, split_pattern()).collect()
    assert bytes(row["decoded"]) == b"one two" and sorted(row.asDict()) == ["decoded", "doc_id", "ids"]
    (row,) = bpe.decode(bpe.encode(df, PATH, split_pattern()), PATH).collect()
    assert bytes(row["decoded"]) == b"one two" and sorted(row.asDict()) == ["decoded", "doc_id", "ids"]


def test_query(spark, plain):
    from frames import texts_of

    rows = QUERIES["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {}
    for doc_id, text, *_ in texts_of("/root/testdata/sf0.001"):
        ids = plain.encode_ordinary(text or "")
        expected[doc_id] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected
