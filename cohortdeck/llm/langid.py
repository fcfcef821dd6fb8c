"""Language identification: bit-sliced Bloom filters of the n-grams typical of each language."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches, staged
from cohortdeck.llm.shingles import mixed

WIDTH = 4
SHORTER = (2, 1)  # widths asked in turn about texts without a typical n-gram
UNKNOWN = "und"
AT_ONCE = 1_000_000  # letters worked on together
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Each code point as itself if it is a letter, else as a blank."""
    codes = np.arange(0x110000, dtype=np.uint32)
    return np.where([chr(c).isalpha() for c in range(0x110000)], codes, np.uint32(ord(" ")))


def grams(texts: Sequence[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the n-grams of the lower-cased texts laid end to end, each text's first and last, its count of letters.

    What isn't a letter is a blank; a text has one blank before it and a gram ending at
    each of its symbols and the blank after it.
    """
    lowered = [" " * (width - 1) + (t or "").lower() + " " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = letters()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")]
    wide = codes.astype(np.uint64)
    found = np.zeros(len(wide) - width + 1 if len(wide) else 0, np.uint64)
    for k in range(width):
        found = found * FACTOR + wide[k : len(found) + k]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    known = np.r_[0, np.cumsum(codes != ord(" "))]
    return mixed(found), starts, ends - width + 1, known[ends] - known[starts]


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + WIDTH
        if held and held + size > AT_ONCE:
            yield first, i
            first, held = i, 0
        held += size
    if texts:
        yield first, len(texts)


def gram_counts(known: DataFrame, widths: Sequence[int] = (WIDTH,)) -> DataFrame:
    """lang, width, gram, n over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for (a, b), width in ((part, width) for part in portions(texts) for width in widths):
                    found, starts, ends, _ = grams(texts[a:b], width)
                    inside = np.zeros(len(found) + width, np.int64)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    seen, counts = np.unique(found[np.cumsum(inside)[: len(found)] > 0], return_counts=True)
                    columns = [pa.array([lang] * len(seen), pa.string()), pa.array([width] * len(seen), pa.int32())]
                    columns += [pa.array(seen.view(np.int64)), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "width", "gram", "n"])

    counted = map_batches(known, run, "lang string, width int, gram bigint, n bigint")
    return counted.groupBy("lang", "width", "gram").agg(F.sum("n").alias("n"))


def typical(counts: DataFrame, least: float, share: float) -> DataFrame:
    """lang, width, total and the grams its filter of that width holds.

    A gram is typical if it makes up at least ``least`` of its language's grams, so there
    are at most ``1 / least`` of them, and at least ``share`` of the portion it has in the
    language where it is most frequent, so passages in another language don't spread
    every gram to every filter.
    """
    totals = counts.groupBy("lang", "width").agg(F.sum("n").alias("total"))
    portion = counts.join(totals, ["lang", "width"]).select("lang", "width", "gram", "total", (F.col("n") / F.col("total")).alias("portion"))
    frequent = portion.filter(F.col("portion") >= least)
    most = F.max("portion").over(Window.partitionBy("width", "gram"))  # one row per language at most
    return frequent.withColumn("most", most).filter(F.col("portion") >= share * F.col("most")).select("lang", "width", "gram", "total")


class Filters:
    """A row per bit position, a bit per language: one look returns all languages that have the position set."""

    def __init__(self, langs: list[str], rows: np.ndarray, hashes: int, width: int = WIDTH, shorter: Filters | None = None):
        self.langs, self.rows, self.hashes, self.width, self.shorter = langs, rows, hashes, width, shorter
        filled = [np.count_nonzero(rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(rows) for i in range(len(langs))]
        self.chance = np.array(filled) ** hashes  # how often a gram no text had is reported

    def masks(self, found: np.ndarray, word: int) -> np.ndarray:
        """Languages 64 * word to 64 * word + 63 that hold each gram."""
        size = np.uint64(len(self.rows) - 1)
        step = (found >> np.uint64(32)) | np.uint64(1)
        out = self.rows[found & size, word]
        for k in range(1, self.hashes):
            out = out & self.rows[(found + np.uint64(k) * step) & size, word]
        return out

    def rates(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each language's corrected share of each text's grams, and the texts' counts of letters."""
        found, starts, ends, n_letters = grams(texts, self.width)
        n = (ends - starts).astype(float)
        rates = np.zeros((len(self.langs), len(texts)))
        for word in range(self.rows.shape[1]):
            masks = self.masks(found, word)
            for i in range(64 * word, min(64 * word + 64, len(self.langs))):
                hits = np.r_[0, np.cumsum(masks >> np.uint64(i % 64) & np.uint64(1), dtype=np.int64)]
                rates[i] = np.maximum(0, ((hits[ends] - hits[starts]) / n - self.chance[i]) / max(1e-9, 1 - self.chance[i]))
        return rates, n_letters

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for a, b in portions(texts):
            rates, n_letters = self.rates(texts[a:b])
            missed = [j for j in range(b - a) if n_letters[j] and not rates[:, j].any()] if self.shorter else []
            again = dict(zip(missed, self.shorter.predict([texts[a + j] for j in missed]))) if missed else {}
            for j in range(b - a):
                if not n_letters[j] or not self.langs:
                    yield UNKNOWN, 0.0
                elif j in again:
                    yield again[j]
                else:
                    best = int(rates[:, j].argmax())
                    whole = float(rates[:, j].sum())
                    yield self.langs[best], float(rates[best, j]) / whole if whole else 0.0


def learn(
    known: DataFrame, least: float = 1e-5, share: float = 0.2, bits: int = 1 << 20, hashes: int = 3, shorter: Sequence[int] = SHORTER
) -> Filters:
    """Filters from rows (lang, text) of known language: ``8 * bits`` bytes a width for up to 64 languages, whatever the input.

    Languages are ordered by how much of them was learned, then by name, which decides ties.
    """
    widths = (WIDTH, *shorter)
    grams_of = staged(typical(staged(gram_counts(known, widths), "language-grams"), least, share), "typical-grams")
    totals = grams_of.filter(F.col("width") == WIDTH).select("lang", "total").distinct().collect()  # a row a language
    langs = [r.lang for r in sorted(totals, key=lambda r: (-r.total, r.lang))]
    filters = None
    for width in reversed(widths):
        filters = Filters(langs, filter_rows(grams_of.filter(F.col("width") == width), langs, bits, hashes), hashes, width, filters)
    return filters


def filter_rows(grams_of: DataFrame, langs: list[str], bits: int, hashes: int) -> np.ndarray:
    """The bits of (lang, gram), merged by position before the at most ``bits`` rows are fetched."""
    rows = np.zeros((bits, max(1, -(-len(langs) // 64))), np.uint64)
    for i in range(0, len(langs), 64):
        place = F.create_map(*[F.lit(x) for k, lang in enumerate(langs[i : i + 64]) for x in (lang, k)])
        own = grams_of.filter(F.col("lang").isin(*langs[i : i + 64])).select("gram", place[F.col("lang")].alias("place"))
        step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
        # Same positions as Filters.masks: the low bits of gram + k * step, which don't depend on sign.
        low = [(F.col("gram").bitwiseAND(bits - 1) + k * step.bitwiseAND(bits - 1)).bitwiseAND(bits - 1) for k in range(hashes)]
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))
        merged = own.select(F.explode(F.array(*low)).alias("row"), bit.alias("bit")).groupBy("row").agg(F.bit_or("bit").alias("mask"))
        found = merged.toArrow()
        rows[found["row"].to_numpy(), i // 64] = found["mask"].to_numpy().view(np.uint64)
    return rows


def held_out(docs: DataFrame, part: int = 2, parts: int = 4) -> F.Column:
    """Documents set aside from training, by the checksum of their id; a null id is not set aside."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text).

    Each of a text's n-grams is looked up in all filters at once.  A language's share of
    hits is corrected for the hits its filter would report by chance; the largest decides
    and the score is its part of the sum of all shares.  A text none of whose 4-grams is
    typical of a language is decided by pairs, then by single letters.  Ties, and texts of
    which nothing was ever learned, go to the language most was learned of.  ``und`` with
    score 0 for a null text, one without letters, or if no language was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sent.value.predict(batch.column(2).to_pylist()))
            pred, score = pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pred, score], ["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("bigint"), held_out(docs).alias("held_out"), F.col("text").cast("string"))
    return map_batches(plain, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_of_each(docs: DataFrame) -> DataFrame:
    """``identify`` with filters learned from the rows of ``docs`` (doc_id, text, lang) that are not held out.

    Rows with a null id or language teach nothing; rows that repeat count each time.
    """
    teaching = docs.filter(~held_out(docs) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    return identify(docs, learn(teaching.select(F.col("lang").cast("string"), F.col("text").cast("string"))))
