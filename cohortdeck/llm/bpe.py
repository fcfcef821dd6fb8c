"""Byte-level BPE by replaying the merges over all words of a part of the corpus at once.

A task reads its documents, cuts each into matches of the split pattern and numbers the
different words.  Words that are new are laid end to end as bytes, and an inverted index
leads from each mergeable pair, by the rank of the token it makes, to the places it starts
at.  Merges are applied in rank order, all places of a pair from left to right; a merge
touches its two neighbours only, whose new pairs enter the index.  Documents are then
written as the ids of their words.

Ranks come from a vocabulary file, whose size bounds what a task holds of it.  No row is
moved: a lost executor's documents are read again.  What a task holds beside the batch is
bounded by the words of a part of the corpus (``most_words`` occurrences) and of its
word list (``most_letters`` letters, then begun anew); one word may be longer, of any length.

A null text has no ids, and no ids decode to no bytes; repeated rows are encoded each.  The
result has the columns of the input without the text, and ``ids``; a column of that name
is replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from cohortdeck.llm.common import map_batches


class Vocabulary:
    """Tokens by rank, and which two tokens make which."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.set_ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def set_ranks(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = array("q"), array("i")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.frombuffer(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.keys, self.made = (np.array(x, kind)[order] for x, kind in ((keys, np.int64), (made, np.int32)))
        # Tokens that are part of a token of lower rank: their merges may have to wait for one another.
        parts = np.concatenate([self.keys >> 32, self.keys & 0xFFFFFFFF])
        self.inside_lower = set(parts[np.concatenate([self.made, self.made]) < parts].tolist())

    def pair_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each two neighbours make, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int32)
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], np.int32(-1))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


MOST_WORDS, MOST_LETTERS = 1_500_000, 3_000_000


def distinct(places: np.ndarray) -> np.ndarray:
    """Different places in order."""
    places = np.sort(places)
    return places[np.diff(places, prepend=-1) != 0]


class Replay:
    """Words end to end as linked symbols, with the inverted index of their mergeable pairs.

    The arrays are read and written one by one where a pair has few places, and all at
    once where it has many.
    """

    def __init__(self, words: list[bytes], vocab: Vocabulary):
        self.vocab = vocab
        self.sizes = np.array([len(word) for word in words], np.int64)
        self.ends = np.cumsum(self.sizes)
        symbols = vocab.bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        real = self.sizes > 0
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[self.ends[real] - 1] = -1
        before[(self.ends - self.sizes)[real]] = -1
        pairs = np.full(n, -1, np.int32)
        inner = np.flatnonzero(following >= 0)
        pairs[inner] = vocab.pair_all(symbols[inner], symbols[inner + 1])
        self.arrays = [array("i", x.tobytes()) for x in (symbols, pairs, following, before)]
        self.views = [np.frombuffer(x, np.int32) for x in self.arrays]
        self.gone = bytearray(n)
        self.borders = self.ends.tolist()
        self.index: dict[int, list] = {}
        self.heap: list[int] = []
        self.enter(pairs, np.arange(n, dtype=np.int32))

    def enter(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Add places that have a rank to the index."""
        real = ranks >= 0
        ranks, places = ranks[real], places[real]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for start, end in zip(cuts, [*cuts, len(ranks)][1:], strict=True):
            self.add(int(ranks[start]), places[start:end])

    def add(self, rank: int, places) -> None:
        if rank in self.index:
            self.index[rank].append(places)
        else:
            self.index[rank] = [places]
            heappush(self.heap, rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """All merges in rank order; the ids that remain, and how many each word has."""
        pair = self.views[1]
        while self.heap:
            rank = heappop(self.heap)
            found = self.index.pop(rank)
            if len(found) == 1 and isinstance(found[0], int):
                places = found
            else:
                places = distinct(found[0] if len(found) == 1 else np.concatenate([np.atleast_1d(x) for x in found]))
                places = places[pair[places] == rank]
                if len(places) >= 24:
                    places = self.merge_all(rank, places)
                places = places.tolist()
            self.merge_each(rank, places)
        alive = np.frombuffer(self.gone, np.uint8) == 0
        counts = np.diff(np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], self.ends])])
        return self.views[0][alive], counts

    def merge_all(self, rank: int, places: np.ndarray) -> np.ndarray:
        """Merge at all places at once; returns places whose words need one merge after the other.

        Those are words where a merge makes a pair of lower rank, which then comes first.
        """
        symbol, pair, following, before = self.views
        # Of places that overlap (as in a run of one letter) every second one counts, from the left.
        every = places
        chained = np.concatenate([[False], following[places[:-1]] == places[1:]])
        if chained.any():
            k = np.arange(len(places))
            first = np.maximum.accumulate(np.where(chained, 0, k))
            places = places[(k - first) % 2 == 0]
        rest = places[:0]
        if rank in self.vocab.inside_lower:
            rest = self.with_lower(rank, places, every)
            places = np.setdiff1d(places, rest)
        second = following[places]
        after = following[second]
        symbol[places], pair[second], following[places] = rank, -1, after
        np.frombuffer(self.gone, np.uint8)[second] = 1
        right = after >= 0
        before[after[right]] = places[right]
        previous = before[places]
        touched = distinct(np.concatenate([places, previous[previous >= 0]]))
        open_end = following[touched] < 0
        pair[touched[open_end]] = -1
        touched = touched[~open_end]
        new = pair[touched] = self.vocab.pair_all(symbol[touched], symbol[following[touched]])
        self.enter(new, touched)
        return rest

    def with_lower(self, rank: int, places: np.ndarray, every: np.ndarray) -> np.ndarray:
        """Those of ``every`` place whose word gets a pair of lower rank by merges at ``places``."""
        symbol, _, following, before = self.views
        second = following[places]
        after, previous = following[second], before[places]
        right, left = np.flatnonzero(after >= 0), np.flatnonzero(previous >= 0)
        # As seen while merging from the left: what follows is unmerged yet, what comes before may be merged.
        met = symbol[previous[left]]
        at = np.searchsorted(second, previous[left])
        met[second[np.minimum(at, len(second) - 1)] == previous[left]] = rank
        new_right = self.vocab.pair_all(np.full(len(right), rank), symbol[after[right]])
        new_left = self.vocab.pair_all(met, np.full(len(left), rank))
        low = np.concatenate([right[(new_right >= 0) & (new_right < rank)], left[(new_left >= 0) & (new_left < rank)]])
        words = np.searchsorted(self.ends, places[low], side="right")
        return every[np.isin(np.searchsorted(self.ends, every, side="right"), words)] if len(low) else every[:0]

    def merge_each(self, rank: int, places: list[int]) -> None:
        symbol, pair, following, before = self.arrays
        gone, add = self.gone, self.add
        rank_of, token = self.vocab.ranks.get, self.vocab.tokens
        own = token[rank]
        waiting: list[int] = []
        wait_until = -1
        for p in places:
            if pair[p] != rank:  # merged with a neighbour meanwhile
                continue
            if p < wait_until:
                waiting.append(p)
                continue
            q = following[p]
            after, previous = following[q], before[p]
            symbol[p], pair[q], gone[q], following[p] = rank, -1, 1, after
            low = False
            if after >= 0:
                before[after] = p
                new = pair[p] = rank_of(own + token[symbol[after]], -1)
                if new >= 0:
                    low = new < rank
                    add(new, p)
            else:
                pair[p] = -1
            if previous >= 0:
                new = pair[previous] = rank_of(token[symbol[previous]] + own, -1)
                if new >= 0:
                    low = low or new < rank
                    add(new, previous)
            if low:  # the rest of this word comes after its lower merge
                wait_until = self.borders[bisect_right(self.borders, p)]
        for p in waiting:
            add(rank, p)


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and how many each word has.

    Each word's merges come lowest rank first and, among equals, leftmost first.
    """
    return Replay(words, vocab).run()


class Numbered(dict):
    """Numbers texts as they come, and counts their letters."""

    letters = 0

    def __missing__(self, text) -> int:
        number = self[text] = len(self)
        self.letters += len(text)
        return number


class Lexicon:
    """The words met so far and their ids."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab = vocab
        self.cut = regex.compile(pattern).findall
        self.words = Numbered()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words."""
        words = self.cut(text or "")
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def encode_new(self) -> None:
        """Ids of the words numbered since the last call: a word that is a token is that token, others are replayed."""
        words = [word.encode() for word in islice(self.words, len(self.ends) - 1, None)]
        whole = np.fromiter((self.vocab.ranks.get(word, -1) for word in words), np.int32, len(words))
        ids, counts = replay([word if rank < 0 else b"" for word, rank in zip(words, whole.tolist(), strict=True)], self.vocab)
        ready = np.flatnonzero(whole >= 0)
        starts = np.concatenate([[0], np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, np.insert(ids, starts[ready], whole[ready])])
        counts[ready] = 1
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and the end of each."""
        return gathered(self.ids, self.ends, numbers)


def gathered(values: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` with these numbers end to end, and the end of each; run k lies before ``ends[k + 1]``."""
    starts = ends[numbers]
    sizes = ends[numbers + 1] - starts
    to = np.cumsum(sizes)
    total = int(to[-1]) if len(to) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    return values[np.repeat((starts - (to - sizes)).astype(kind), sizes) + np.arange(total, dtype=kind)], to


def _encoded(path: str, pattern: str, at: int, names: list[str], most_words: int, most_letters: int):
    """Batches without their text column and with ids at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(vocabulary(path), pattern)
        held: list[list[pa.Array]] = []
        numbers: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal lexicon
            lexicon.encode_new()
            document = 0
            for columns, rows in held:
                own = numbers[document : document + rows]
                document += rows
                ids, ends = lexicon.ids_of(np.concatenate(own))
                offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in own])])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*columns, lists], names)
            held.clear()
            numbers.clear()
            if lexicon.words.letters > most_letters:
                lexicon = Lexicon(lexicon.vocab, pattern)

        def hold(batch: pa.RecordBatch, start: int, end: int) -> None:
            if end > start:
                held.append(([c.slice(start, end - start) for k, c in enumerate(batch.columns) if k != at], end - start))

        room = most_words
        for batch in batches:
            start = 0
            for k, value in enumerate(batch.column(at)):
                numbers.append(lexicon.numbers(value.as_py()))
                room -= 1 + len(numbers[-1])
                if room < 0 or lexicon.words.letters > most_letters:
                    hold(batch, start, k + 1)
                    start, room = k + 1, most_words
                    yield from out()
            hold(batch, start, batch.num_rows)
        if held:
            yield from out()

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", most_words: int = MOST_WORDS, most_letters: int = MOST_LETTERS) -> DataFrame:
    """``docs`` with the token ids of each text in place of the text."""
    rest = [f for f in docs.schema if f.name not in (text, "ids")]
    docs = docs.select(*[f"`{f.name}`" for f in rest], f"`{text}`")
    schema = StructType([*rest, StructField("ids", ArrayType(IntegerType(), False))])
    return map_batches(docs, _encoded(path, pattern, len(rest), schema.names, most_words, most_letters), schema)


def _decoded(path: str, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).tokens.__getitem__
        for batch in batches:
            ids = batch.column(at).flatten().to_numpy()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy()).tolist()
            found = [b"".join(map(token, ids[start:end].tolist())) for start, end in zip([0, *ends], ends, strict=False)]
            for part in _batches_of(found):
                columns = [*(c.slice(part.start, len(part)) for c in batch.columns), pa.array(found[part.start : part.stop], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _batches_of(values: list[bytes], most: int = 32_000_000) -> Iterator[range]:
    """Ranges of rows with about ``most`` bytes."""
    start = 0
    for k, size in enumerate(accumulate(map(len, values))):
        if size // most > (size - len(values[k])) // most:
            yield range(start, k + 1)
            start = k + 1
    if start < len(values):
        yield range(start, len(values))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes the ids stand for; a column of that name is replaced."""
    rest = [f for f in encoded.schema if f.name != "decoded"]
    schema = StructType([*rest, StructField("decoded", BinaryType())])
    at = [f.name for f in rest].index(ids)
    return map_batches(encoded.select(*[f"`{f.name}`" for f in rest]), _decoded(path, at, schema.names), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass of the same workers."""
    rest = [f for f in docs.schema if f.name not in (text, "ids", "decoded")]
    coded = [*rest, StructField("ids", ArrayType(IntegerType(), False))]
    schema = StructType([*coded, StructField("decoded", BinaryType())])
    encoded = _encoded(path, pattern, len(rest), [f.name for f in coded], MOST_WORDS, MOST_LETTERS)
    decoded = _decoded(path, len(rest), schema.names)
    docs = docs.select(*[f"`{f.name}`" for f in rest], f"`{text}`")
    return map_batches(docs, lambda batches: decoded(encoded(batches)), schema)
