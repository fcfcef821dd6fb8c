"""Benchmark decontamination: pigeonhole pieces found exactly, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches

WORDS = re.compile(r"\w+")
HITS = "doc_id bigint, item_id bigint, distance int, start bigint, stop bigint, n_found int"


def normal(text: str | None) -> str:
    """Lower-cased words joined by single spaces."""
    return " ".join(WORDS.findall(text or "")).lower()


def original_span(text: str, start: int, stop: int) -> tuple[int, int]:
    """Where in ``text`` the words lie that ``normal(text)[start:stop]`` touches."""
    words = list(WORDS.finditer(text))
    begins = list(accumulate((len(w.group().lower()) + 1 for w in words), initial=0))
    first, last = bisect_right(begins, start) - 1, bisect_right(begins, max(start, stop - 1)) - 1
    return words[first].start(), words[min(last, len(words) - 1)].end()


def masks(pattern: str) -> dict[str, int]:
    """Per letter, the bits of its places in ``pattern``."""
    found: dict[str, int] = {}
    for i, letter in enumerate(pattern):
        found[letter] = found.get(letter, 0) | 1 << i
    return found


def myers(at: dict[str, int], size: int, text: str, anchored: bool = False) -> list[int]:
    """Edit distances of a pattern (its masks and size) to the stretches of ``text`` that end at each place.

    The whole column of the distance table is two integers of ``size`` bits.  A stretch
    may begin anywhere, or with the text if ``anchored``.
    """
    full, high, carry = (1 << size) - 1, 1 << (size - 1), int(anchored)
    more, less, score, scores = full, 0, size, []
    for letter in text:
        equal = at.get(letter, 0)
        down = equal | less
        across = (((equal & more) + more) ^ more) | equal
        plus = less | (full & ~(across | more))
        minus = more & across
        score += 1 if plus & high else -1 if minus & high else 0
        plus = plus << 1 | carry
        minus <<= 1
        more = (minus | ~(down | plus)) & full
        less = plus & down & full
        scores.append(score)
    return scores


class Benchmark:
    """Items of one block: their pieces in one automaton, built once per worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        self.items = [(item, text) for item, text in items if text]
        self.rate, self.least = rate, least
        self.built = False

    def budget(self, size: int) -> int:
        """Errors allowed: ``rate`` of the letters, as long as pieces keep ``least`` of them."""
        return max(0, min(int(size * self.rate), size // self.least - 1))

    def build(self) -> None:
        pieces: dict[str, list[tuple[int, int]]] = {}
        for place, (_, text) in enumerate(self.items):
            parts = self.budget(len(text)) + 1
            cuts = [len(text) * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((place, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.masks = [masks(text) for _, text in self.items]
        self.reversed = [masks(text[::-1]) for _, text in self.items]
        self.built = True

    def found_in(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, start, stop, occurrences) per item in ``text``; the closest occurrence, then the first."""
        if not self.built:
            self.build()
        clean = normal(text)
        if not self.items or not clean:
            return []
        near: dict[int, set[int]] = {}
        for end, (size, owners) in self.automaton.iter(clean):
            for place, offset in owners:
                near.setdefault(place, set()).add(end + 1 - size - offset)
        rows = []
        for place, starts in near.items():
            hits = list(self.verified(clean, place, sorted(starts)))
            if hits:
                distance, start, stop = min(hits)
                rows.append((self.items[place][0], distance, *original_span(text, start, stop), len(hits)))
        return sorted(rows, key=lambda r: r[0])

    def verified(self, clean: str, place: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """(distance, start, stop) of the item around the starts that its pieces suggest."""
        pattern = self.items[place][1]
        size, errors = len(pattern), self.budget(len(pattern))
        done = -1
        if not errors:  # the piece is the whole item, which must stand between word borders
            for start in starts:
                borders = (start == 0 or clean[start - 1] == " ") and clean[start + size : start + size + 1] in ("", " ")
                if start >= done and borders:
                    done = start + size
                    yield 0, start, done
            return
        k = 0
        while k < len(starts):
            first = last = starts[k]
            while k < len(starts) and starts[k] - last <= 2 * errors:
                last = starts[k]
                k += 1
            a, b = max(0, first - errors, done), min(len(clean), last + size + errors)
            scores = myers(self.masks[place], size, clean[a:b])
            while scores and min(scores) <= errors:
                at = scores.index(min(scores))
                stop = a + at + 1
                back = myers(self.reversed[place], size, clean[max(a, stop - size - errors) : stop][::-1], anchored=True)
                start = stop - 1 - back.index(scores[at])
                yield scores[at], start, stop
                done = stop
                a, scores = stop, myers(self.masks[place], size, clean[stop:b])


def blocks(items: DataFrame, rate: float, least: int, letters: int) -> Iterator[Benchmark]:
    """The items (item_id, text) in blocks of about ``letters`` letters, each small enough to send to all workers."""
    usable = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("item_id IS NOT NULL")
    usable = usable.dropDuplicates()
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // letters) or 1
    for block in range(count):
        own = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield Benchmark([(r.item_id, normal(r.text)) for r in own.toLocalIterator()], rate, least)


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.06, least: int = 14, letters: int = 1_000_000) -> DataFrame:
    """Every benchmark item found in every document, up to an edit distance.

    Texts and items are compared as lower-cased words with single spaces.  An item of n
    letters may differ by ``rate * n`` insertions, deletions and replacements (fewer where
    its pieces would be shorter than ``least`` letters; items shorter than twice that must
    occur exactly, as whole words).  It is cut into one piece more than that, so at least one piece occurs
    unchanged; pieces are found in one pass over each text, and the stretch around each is
    verified with Myers' distance.

    One row per document row and item: doc_id, item_id, distance, start and stop in the
    text (code points, of whole words) of the closest, then first occurrence, n_found (how
    many occurrences).  Documents stay where they are; items are sent to all workers in
    blocks of about ``letters`` letters, one pass a block.  Null, empty and wordless texts
    and items match nothing, nor do items without an id.  Items that share an id are all
    looked for.  Other columns are not read.
    """
    out = None
    for block in blocks(items, rate, least, letters):
        found = map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), finder(docs, block), HITS)
        out = found if out is None else out.union(found)
    return out


def finder(docs: DataFrame, block: Benchmark):
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in HITS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows = [
                (doc_id, *hit)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for hit in sent.value.found_in(text.as_py())
            ]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.06, least: int = 14, letters: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds no item, with their columns."""
    for block in blocks(items, rate, least, letters):
        docs = map_batches(docs, cleaner(docs, block), docs.schema)
    return docs


def cleaner(docs: DataFrame, block: Benchmark):
    sent = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not sent.value.found_in(text.as_py()) for text in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
