"""Small frames with the cases every operator must stand, and plain references for them."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns whose names the operators use inside.
EXTRA = "id string, key string, label string, lines string, n bigint, rep string, low string, start string, word string, `a b` string"


def sentence(seed: int, words: int = 60) -> str:
    """Different words for different seeds, the same for the same."""
    return " ".join(f"w{zlib.crc32(f'{seed}:{k}'.encode()) % 9973}" for k in range(words))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long_text = "\n".join(sentence(900 + k, 12) for k in range(1500))
    copy = sentence(1) + "\n" + sentence(2)
    return [
        (1, copy, "en", "a", 10),
        (2, copy, "en", "a", 10),
        (2, copy, "en", "a", 10),
        (3, copy + " more words here", "de", None, None),
        (4, None, None, "b", 0),
        (5, "", "en", "b", 0),
        (6, " \t\n\x0b\x0c\r \n", "fr", "b", 4),
        (7, long_text, "en", "a", len(long_text)),
        (8, "one", "en", "c", 3),
        (9, "one two three four", "en", "c", 3),
        (10, "ONE two Three four", "es", "c", 3),
        (None, sentence(5), "en", "a", 1),
        (12, "ünïcödé ßtraße été 日本語 😀 line\r\nünïcödé ßtraße été 日本語 😀 line", "de", "d", 1),
        (13, sentence(1) + "\n\n" + sentence(7) + "\n" + sentence(7), None, None, None),
    ]


def frame(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(odd_documents() if rows is None else rows, COLUMNS)
    if extra:
        for part in EXTRA.split(", "):
            name, kind = part.rsplit(" ", 1)
            df = df.selectExpr("*", f"cast('7' as {kind}) as {name}")
    return df


def collected(df, *names):
    rows = [tuple(r) for r in df.select(*(names or df.columns)).collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts_of(sf_dir: str, count: int | None = None):
    import duckdb

    found = duckdb.execute(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    return found[:count]
