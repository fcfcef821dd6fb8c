import collections
import zlib

import numpy as np
from frames import empty, frame, odd_documents

from cohortdeck.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_of_each(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 200
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_documents_teach_nothing(spark):
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(out, "zzz yyy xxx", "xx", None, None)] + [
        (i, "alpha beta gamma delta", "aa", None, None) for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2
    ]
    found = {r.doc_id: r for r in langid.language_of_each(frame(spark, rows)).collect()}
    assert found[out].held_out and found[out].lang_pred == "aa"
    assert sum(r.held_out for r in found.values()) == 1


def test_filters_return_all_languages(spark):
    """No typical gram is missed in any of its languages, among more languages than one word of bits holds."""
    rows = [(f"l{k:03d}", f"shared words here and {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{k} own{chr(97 + k % 26) * 4}") for k in range(70)]
    known = spark.createDataFrame(rows, "lang string, text string")
    filters = langid.learn(known, bits=1 << 14)
    grams = langid.typical(langid.gram_counts(known), 1e-5, 0.2).collect()
    assert len(filters.langs) == 70 and filters.rows.shape == (1 << 14, 2)
    for r in grams:
        i = filters.langs.index(r.lang)
        assert int(filters.masks(np.array([r.gram], np.int64).view(np.uint64), i // 64)[0]) >> (i % 64) & 1
    assert (filters.chance < 0.2).all()


def test_odd_documents(spark):
    found = langid.language_of_each(frame(spark, extra=True)).collect()
    assert len(found) == len(odd_documents())
    for r in found:
        if r.doc_id in (4, 5, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    digits = langid.identify(frame(spark, [(1, "123 !?", "en", "a", 1)]), langid.Filters(["en"], np.zeros((8, 1), np.uint64), 2))
    assert [(r.lang_pred, r.score) for r in digits.collect()] == [("und", 0.0)]


def test_nothing_to_learn_from(spark):
    rows = [(1, "some words", None, None, None)]
    assert [r.lang_pred for r in langid.language_of_each(frame(spark, rows)).collect()] == ["und"]
    assert langid.language_of_each(empty(spark)).collect() == []


def plain_grams(text, width):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    padded = " " * (width - 1) + letters + " "
    return [padded[i : i + width] for i in range(len(padded) - width + 1)]


def plain_model(known, width, least=1e-5, share=0.2):
    counts = {}
    for lang, text in known:
        counts.setdefault(lang, collections.Counter()).update(plain_grams(text, width))
    portion = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = collections.Counter()
    for of in portion.values():
        for g, p in of.items():
            most[g] = max(most[g], p)
    order = sorted(counts, key=lambda lang: (-sum(counts[lang].values()), lang))
    return {lang: {g for g, p in portion[lang].items() if p >= least and p >= share * most[g]} for lang in order}


def plain_prediction(models, text):
    if not any(c.isalpha() for c in (text or "").lower()):
        return {"und": 0.0}
    for width, model in models:
        found = plain_grams(text, width)
        rates = {lang: sum(g in kept for g in found) / len(found) for lang, kept in model.items()}
        if any(rates.values()) or width == models[-1][0]:
            whole = sum(rates.values()) or 1.0
            return {lang: rate / whole for lang, rate in rates.items()}


def test_predictions_against_plain_sets(spark):
    """Filters wide enough to report next to nothing by chance decide as exact sets of grams do."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.filter("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2][:60]
    filters = langid.learn(spark.createDataFrame(rows, "lang string, text string"), bits=1 << 22)
    models = [(width, plain_model(rows, width)) for width in (4, 2, 1)]
    assert filters.langs == list(models[0][1])
    texts = [t for _, t in rows[:20]] + [r.text for r in docs.limit(40).collect()] + ["xyzzy qwfp", "zqxj", "日本", "ß", "12", "", None, "a"]
    for text, (pred, score) in zip(texts, filters.predict(texts)):
        exact = plain_prediction(models, text)
        # Shares that are equal may differ by what their filters report by chance.
        assert exact[pred] > max(exact.values()) - 1e-3 and abs(score - exact[pred]) < 1e-3, text


def test_accuracy_by_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = docs.filter("crc32(cast(doc_id as string)) % 4 = 2 and lang is not null and length(text) > 400").collect()
    teaching = docs.filter("crc32(cast(doc_id as string)) % 4 <> 2 and lang is not null").select("lang", "text")
    filters = langid.learn(teaching)
    for letters, least in [(20, 0.75), (80, 0.9), (300, 0.95)]:
        found = filters.predict([r.text[100 : 100 + letters] for r in pieces])
        right = sum(r.lang == pred for r, (pred, _) in zip(pieces, found))
        assert right >= least * len(pieces), (letters, right, len(pieces))


def test_texts_without_a_hit(spark):
    """Pairs of letters decide where no 4-gram is known; what was learned most where nothing is."""
    rows = [("aa", "zq zqa zqb"), ("bb", "mnop mnop mnop mnop"), ("bb", "mnop mnop mnop")]
    filters = langid.learn(spark.createDataFrame(rows, "lang string, text string"), bits=1 << 14)
    assert filters.langs == ["bb", "aa"]
    found = list(filters.predict(["wwwzqwww", "語", "wwwopwww"]))
    assert [pred for pred, _ in found] == ["aa", "bb", "bb"] and found[0][1] == 1.0
