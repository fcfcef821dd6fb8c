import re
from collections import Counter

import numpy as np
from frames import WORD, collected, empty, frame, odd_documents, sentence, texts_of

from cohortdeck.llm import outliers


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def columns(df):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_base_statistics(spark):
    rows = [(i, t, lang, source, 1) for i, t, lang, source in texts_of("/root/testdata/sf0.001")]
    rows += [(9000, "a b c d e f g h " * 3, "en", "x", 1), (9001, "h " * 30, "en", "x", 1), (9002, "# a\n# a\n\n \n# a", "en", "x", 1)]
    found = outliers.quality_rules(frame(spark, rows))
    assert columns(found) == sorted(((r[0], *base(r[1])) for r in rows), key=str)
    assert all(r.kept is False for r in found.collect() if r.base_failed)


def test_odd_documents(spark):
    found = outliers.quality_rules(frame(spark, extra=True))
    assert columns(found) == sorted(((r[0], *base(r[1])) for r in odd_documents()), key=str)
    assert outliers.quality_rules(empty(spark)).collect() == []


def test_estimate_is_that_of_the_inner_documents(spark):
    """Against numpy: concentration from the same start gives the same centre and covariance."""
    rng = np.random.default_rng(4)
    good = rng.multivariate_normal([1700, 100, 200, 50, 40], np.diag([90, 80, 100, 60, 70]) ** 2, 900)
    bad = rng.multivariate_normal([1500, 900, 900, 900, 900], np.eye(5) * 400, 100)
    points = np.rint(np.vstack([good, bad])).astype(int)
    df = spark.createDataFrame([(*map(int, p), "en", "a") for p in points], ", ".join(f"{x} bigint" for x in outliers.X) + ", lang string, source string")
    shapes = {r.key: r for r in outliers.estimates(df, 0.75, 6).collect()}
    row = shapes["0"]
    centre = np.array([row[f"c{i}"] for i in range(5)])
    assert np.abs(centre - good.mean(axis=0)).max() < 12
    lower = np.zeros((5, 5))
    for i, j in outliers.PAIRS:
        lower[i, j] = row[f"l{i}{j}"]
    floors = np.diag([(f * outliers.UNIT) ** 2 for f in outliers.FLOORS.values()])
    diff = points - centre
    d2 = (diff @ np.linalg.inv(lower @ lower.T) * diff).sum(axis=1)
    inner = points[d2 <= np.sort(d2)[749]]
    assert np.allclose(np.cov(inner.T, bias=True) + floors, lower @ lower.T, rtol=0.1, atol=600)
    assert d2[900:].min() > 3 * d2[:900].max()


def test_odd_shape_is_rejected_and_common_ones_stay(spark):
    rows = [(k, sentence(k, 80), "en", "a", 1) for k in range(150)]
    rows += [(500, " ".join("#$%&" + w for w in sentence(3, 80).split()), "en", "a", 1), (501, sentence(9, 80).upper(), "en", "rare", 1)]
    kept = {r.doc_id: r.kept for r in outliers.quality_rules(frame(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] in ([500, 501], [501, 500])


def test_rows_of_one_id_are_judged_each(spark):
    rows = [(1, sentence(1), "en", "a", 1), (1, "short", "en", "a", 1)]
    assert collected(outliers.quality_rules(frame(spark, rows)), "doc_id", "base_failed") == [(1, False), (1, True)]
