import math
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from frames import collected, empty, frame, odd_documents
from tokenizers import Tokenizer

from cohortdeck.llm.lengths import encoded_lengths, length_histogram, length_quantiles, limit_totals, suffix_sums, with_quantiles
from cohortdeck.llm.packing import Bins, digest, harmonic_pack, powers, slots
from cohortdeck.llm.queries import QUERIES
from cohortdeck.llm.tokens import Encoder, encoder, packed, tokenizer_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(spark):
    texts = ["", " ", "a  b", "foo \n", "don't  we'll\r\n x", "x<|endoftext|>y", "日本語 😀", "a" * 3000, "tab\t b\x1c c\x85"]
    model, plain = Encoder(tokenizer_path()), Tokenizer.from_file(PATH)
    texts += [r[1] for r in odd_documents() if r[1]]
    assert [model.ids(t) for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert model.ids(None) == []


def test_slots_fill_their_classes():
    for length in range(1, 5000):
        found = slots(length, 2048, 32)
        assert sum(n for _, n in found) == length
        assert all(k * n <= 2048 for k, n in found)
    assert powers(1300) == [1024, 256, 16, 4]


def check_pieces(rows, capacity=2048):
    """Sequences are gapless and not too long; every document is whole; the padding."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    return by_doc, padding


def test_odd_documents_round_trip(spark):
    rows = harmonic_pack(frame(spark, extra=True).repartition(3)).collect()
    check_pieces(rows)
    want = {r[0]: packed([*reference_ids(r[1]), 1]) for r in odd_documents()}
    for r in rows:
        assert bytes(r.ids) == want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.doc_tokens == len(want[r.doc_id]) // 4
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == Counter({i: (2 if i == 2 else 1) * len(ids) // 4 for i, ids in want.items()})


def test_digest_is_the_checksum(spark):
    pieces = harmonic_pack(frame(spark))
    want = sorted((r.sequence_id, r.offset, zlib.crc32(bytes(r.ids))) for r in pieces.collect())
    assert collected(digest(pieces), "sequence_id", "offset", "ids_crc32") == sorted(want, key=lambda r: tuple((True, str(v)) for v in r))


def test_little_padding():
    rng = np.random.default_rng(1)
    bins = Bins(0, 2048, 32)
    for k, n in enumerate(rng.lognormal(6, 1.2, 4000).astype(int) + 1):
        bins.add(k, packed([7] * int(n)))
    bins.finish()
    names = "doc_id start length ids doc_tokens sequence_id offset bin_class".split()
    rows = [type("Row", (), dict(zip(names, r))) for r in bins.rows]
    _, padding = check_pieces(rows)
    assert padding < 0.02 * sum(r.length for r in rows)


def test_length_histogram_and_limits(spark):
    docs = frame(spark, extra=True)
    n = [(r[2], len(reference_ids(r[1]))) for r in odd_documents()]
    sums = suffix_sums(length_histogram(docs, ["lang"]), ["lang"], block=4)
    for r in sums.collect():
        own = [k for lang, k in n if lang == r.lang]
        assert r.n_docs == own.count(r.n_tokens)
        assert r.docs_at_least == sum(k >= r.n_tokens for k in own)
        assert r.tokens_at_least == sum(k for k in own if k >= r.n_tokens)
        assert (r.docs_total, r.tokens_total) == (len(own), sum(own))
        assert r.truncated_tokens == sum(min(k, r.n_tokens) for k in own)
    whole = suffix_sums(length_histogram(docs))
    limits = [1, 16, 100, 10**6]
    found = {r.max_tokens: (r.docs_cut, r.truncated_tokens) for r in limit_totals(whole, limits).collect()}
    assert found == {m: (sum(k > m for _, k in n), sum(min(k, m) for _, k in n)) for m in limits}
    ordered = sorted(k for _, k in n)
    q = length_quantiles(whole, [0.5, 1.0]).first()
    assert (q.q500, q.q1000) == (ordered[-(-len(n) // 2) - 1], ordered[-1])


def test_empty_table(spark):
    assert harmonic_pack(empty(spark)).collect() == []
    assert suffix_sums(length_histogram(empty(spark), ["lang"]), ["lang"]).collect() == []


@pytest.mark.parametrize("letters", [" ", "\n", "a", " \t\n"])
def test_very_long_stretches(spark, letters):
    """Millions of blanks, line ends or equal letters in a row, through packing and lengths."""
    text = "begin" + letters * (2_000_000 // len(letters)) + "end"
    expected = encoder(tokenizer_path()).tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder(tokenizer_path()).ids(text) == expected
    df = spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")
    pieces = digest(harmonic_pack(df)).collect()
    assert sum(p["length"] for p in pieces) == len(expected) + 1
    (row,) = length_histogram(df, ["lang"]).collect()
    assert row["n_tokens"] in (len(expected), len(expected) + 1)


def test_length_query_against_brute_force(spark):
    """Every limit and quantile from the query's rows, null languages included."""
    sf_dir = "/root/testdata/sf0.001"
    by_lang = {}
    for row in encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang"]).collect():
        by_lang.setdefault(row.lang, []).append(row.n_tokens)
    found = {}
    for row in QUERIES["op5_length_histogram"](spark, sf_dir).collect():
        found.setdefault(row.lang, []).append(row)
    assert set(found) == set(by_lang)
    for lang, sizes in by_lang.items():
        rows = sorted(found[lang], key=lambda r: r.n_tokens)
        assert [(r.n_tokens, r.n_docs) for r in rows] == sorted(Counter(sizes).items())
        for share, name in [(0.5, "q500"), (0.9, "q900"), (0.99, "q990"), (1.0, "q1000")]:
            assert {r[name] for r in rows} == {sorted(sizes)[math.ceil(round(share * len(sizes), 6)) - 1]}
        for row, after in zip(rows, [*rows[1:], None]):
            for limit in {row.n_tokens, row.n_tokens + 1, (after.n_tokens if after else row.n_tokens + 99) - 1} - {row.n_tokens - 1}:
                assert row.tokens_upto + limit * row.docs_above == sum(min(size, limit) for size in sizes)
            assert row.truncated_tokens == sum(min(size, row.n_tokens) for size in sizes)


def test_quantiles_without_groups(spark):
    sums = suffix_sums(length_histogram(frame(spark)))
    found = with_quantiles(sums, [0.5])
    assert {r.q500 for r in found.collect()} == {length_quantiles(sums, [0.5]).first().q500}
    assert with_quantiles(suffix_sums(length_histogram(empty(spark))), [0.5]).collect() == []
