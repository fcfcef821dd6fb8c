import random
from itertools import combinations

import numpy as np
from frames import WORD, collected, empty, frame, odd_documents, sentence

from cohortdeck.llm.minhash import BINS, band_keys, near_duplicates, signature
from cohortdeck.llm.shingles import shingle_set

LOW = -(1 << 63)


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    sets = [(LOW if r[0] is None else r[0], shingles(r[1])) for r in rows]
    group = {i: i for i, _ in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            low, high = sorted((root(i), root(j)))
            group[high] = low
    blank = lambda i: None if i == LOW else i
    return sorted([(blank(i), len(s), blank(root(i)), i == root(i)) for i, s in sets], key=str)


def near_documents(seed=3):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        words = sentence(base, 120).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            rows.append((len(rows), " ".join(copy), "en", "a", 1))
    rows += [(500 + k, sentence(2, 8) + (" end" if k % 2 else ""), "en", "a", 1) for k in range(6)]
    return rows


def test_odd_documents(spark):
    found = near_duplicates(frame(spark, extra=True))
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_hand(odd_documents())


def test_near_copies_against_all_pairs(spark):
    rows = near_documents()
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == by_hand(rows)


def test_chain_of_neighbours(spark):
    """Each text is like the next one only; all are one group."""
    words = sentence(4, 400).split()
    rows = [(900 - k, " ".join(words[8 * k : 8 * k + 100]), "en", "a", 1) for k in range(30)]
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == by_hand(rows)


def test_links_inside_a_shared_template(spark):
    """Texts of one template meet in its buckets and are unlike each other; only the two with few own words are linked."""
    template = sentence(70, 229)
    rows = [(k, f"{template} " + " ".join(f"own{k}x{i}" for i in range(75 if k < 400 else 30)), "en", "a", 1) for k in range(402)]
    found = sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert [r[0] for r in found if not r[3]] == [401]
    assert found == by_hand(rows)


def test_signature_agrees_as_often_as_sets(spark):
    a = np.arange(1, 401, dtype=np.uint64)
    x, y = (shingle_set(" ".join(map(str, part)).encode(), 1) for part in (a[:320], a[80:]))
    assert abs((signature(x) == signature(y)).mean() - 0.6) < 0.12
    assert len(band_keys(x, 5)) == BINS // 5
    one = signature(shingle_set(b"single"))
    assert (one == one[0]).all()


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], empty(spark).schema)
    assert collected(near_duplicates(nothing)) == [(1, 0, 1, True), (2, 0, 2, True)]
