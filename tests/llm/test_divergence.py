"""Divergence of sources against the definitions, written out."""

import random
import re
from collections import Counter, defaultdict

from frames import COLUMNS, empty, frame, odd_documents

from cohortdeck.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    found = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sums = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        sums[None] = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        share = {}
        for s, own in sums.items():
            total = sum(own.values())
            share[s] = {t: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for t, n in own.items()}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(gap(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-gap(share[s][t], share[None][t]), t.encode(), t) for t in kept if sums[s][t] and share[s][t] > share[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(items)]
    return sorted(found)


def ours(df, **options):
    return sorted(map(tuple, divergence.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_odd_documents(spark):
    rows = odd_documents()
    for least in (1, 2, 3):
        assert ours(frame(spark, extra=True), least_docs=least) == brute(rows, least)


def test_many_sources(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(900):
        source = "hot" if k % 3 == 0 else f"s{rnd.randrange(25):02d}"
        text = " ".join(f"Wörd{chr(97 + min(rnd.randrange(26), rnd.randrange(26)))}{'x' * rnd.randrange(3)}" for _ in range(rnd.randrange(40)))
        rows.append((k, text, rnd.choice(["en", "de"]), source, 0))
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    assert ours(df, least_docs=10) == brute(rows, 10)
    assert ours(df, least_docs=10_000) == brute(rows, 10_000)  # no term is kept: every pair is worth 0


def test_slices_make_no_difference(spark):
    rows = [(k, f"one two three{k % 7} " * (k % 5), "en", f"s{k % 4}", 0) for k in range(200)]
    batch = divergence.pa.RecordBatch.from_arrays(
        [divergence.pa.array([r[c] for r in rows], t) for c, t in ((2, "string"), (3, "string"))]
        + [divergence.pa.array([r[1].encode() for r in rows], "binary")], ["lang", "source", "text"]
    )
    assert [x.num_rows for x in divergence._sliced([batch], 2, 500)][:1] != [200]
    assert sum(x.num_rows for x in divergence._sliced([batch], 2, 500)) == 200


def test_empty_table(spark):
    assert ours(empty(spark)) == []


def test_wide_counts(spark):
    """Counts beyond 2^63 / 10^9 stay exact."""
    n = 8 * 10**17
    (row,) = spark.range(1).select(divergence.share(divergence.F.lit(n), divergence.F.lit(n), divergence.F.lit(3)).alias("p")).collect()
    assert row["p"] == 1 + 10**9 * (n + 2) // (n + 6)
