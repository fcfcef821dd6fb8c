import random

from frames import collected, empty, frame, sentence

from cohortdeck.llm import decontamination as d

ITEMS = "item_id bigint, text string, id string"


def table_distance(a, b):
    """Edit distance of a to the stretches of b ending at each place, by the full table."""
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        before = now
    return before[1:]


def test_myers_is_the_table():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
        assert d.myers(d.masks(a), len(a), b) == table_distance(a, b)


def edited(text, edits, rng):
    letters = list(text)
    for _ in range(edits):
        k = rng.randrange(len(letters))
        letters[k : k + 1] = rng.choice([[], ["q"], [letters[k], "z"]])
    return "".join(letters)


def test_edited_items_are_found(spark):
    rng = random.Random(11)
    items = [(k, sentence(50 + k, 30), "x") for k in range(8)]
    rows = []
    for k in range(60):
        item = items[k % 8][1]
        body = edited(d.normal(item), rng.choice([0, 1, 3, 6, 9, 14]), rng)
        rows.append((k, f"{sentence(200 + k)}. {body}\n{sentence(300 + k)}" if k % 3 else sentence(400 + k), "en", "a", 1))
    found = d.leaks(frame(spark, rows), spark.createDataFrame(items, ITEMS), letters=700)
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    want = {}
    for doc_id, text, *_ in rows:
        for item_id, item, _ in items:
            pattern = d.normal(item)
            least = min(table_distance(pattern, d.normal(text)))
            if least <= d.Benchmark([], 0.06, 14).budget(len(pattern)):
                want[doc_id, item_id] = least
    assert got == want
    clean = d.keep_clean(frame(spark, rows), spark.createDataFrame(items, ITEMS), letters=700)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {doc for doc, _ in want}


def test_span_is_in_the_text(spark):
    item = "The Quick, brown fox\njumps over the lazy dog again"
    text = "Ünd so: the quick   BROWN fox jumps over the lazy dog again! The quick brown fox jumps over the lazy dog again"
    df = frame(spark, [(1, text, "en", "a", 1)])
    row = d.leaks(df, spark.createDataFrame([(7, item, "x")], ITEMS)).first()
    assert (row.distance, row.n_found) == (0, 2)
    assert text[row.start : row.stop] == "the quick   BROWN fox jumps over the lazy dog again"


def test_odd_documents_and_items(spark):
    items = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, " .!? ", "x"), (None, sentence(1), "x"), (4, sentence(1), "x"), (4, sentence(1), "x"), (5, sentence(2), "x")],
        ITEMS,
    )
    found = d.leaks(frame(spark, extra=True), items)
    assert collected(found.select("doc_id", "item_id", "distance")) == sorted(
        [(i, k, 0) for i in (1, 2, 2, 3) for k in (4, 5)] + [(13, 4, 0)], key=lambda r: tuple((True, str(v)) for v in r)
    )
    nothing = items.filter("item_id = 1")
    assert d.leaks(frame(spark), nothing).collect() == [] and d.leaks(empty(spark), items).collect() == []
    assert d.keep_clean(frame(spark), nothing).count() == frame(spark).count()


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "yes", "x"), (2, "b c", "x")], ITEMS)
    rows = [(1, "my eyes are open", "en", "a", 1), (2, "eyes? Yes!", "en", "a", 1), (3, "ab c", "en", "a", 1), (4, "b cd, a b c", "en", "a", 1), (5, "yesyes yes yes", "en", "a", 1)]
    found = d.leaks(frame(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.n_found) for r in found) == [(2, 1, 0, 1), (4, 2, 0, 1), (5, 1, 0, 2)]
    assert sorted(r.doc_id for r in d.keep_clean(frame(spark, rows), items).collect()) == [1, 3]
