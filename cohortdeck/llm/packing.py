"""Harmonic packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches
from cohortdeck.llm.tokens import encoder, packed, tokenizer_path

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, bin_class int"
)


def slots(length: int, capacity: int, spare: int) -> list[tuple[int, int]]:
    """Cut ``length`` tokens into (class, piece length).

    A bin of class k takes k pieces of at most ``capacity // k`` tokens.  A piece that
    leaves at most 1/``spare`` of its slot empty stays whole; otherwise a piece as long
    as the next smaller slot is cut off.
    """
    found = [(1, capacity)] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left
        slot = capacity // k
        if (slot - left) * spare <= slot:
            found.append((k, left))
            break
        found.append((k + 1, capacity // (k + 1)))
        left -= capacity // (k + 1)
    return found


def powers(length: int) -> list[int]:
    """``length`` as a falling sum of powers of two."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


class Bins:
    """One worker's open bins, at most one per class; a full bin leaves at once."""

    def __init__(self, first_id: int, capacity: int, spare: int):
        self.next_id, self.capacity, self.spare = first_id, capacity, spare
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list, k: int) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.next_id, offset, k))
            offset += n
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for k, n in slots(total, self.capacity, self.spare):
            pieces = self.open.setdefault(k, [])
            pieces.append((doc_id, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(pieces) == k:
                self.close(self.open.pop(k), k)

    def finish(self) -> None:
        """Lay what is left in the open bins end to end: full sequences, then powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        rest = sum(len(p[2]) for p in left) // 4
        sizes = [self.capacity] * (rest // self.capacity) + powers(rest % self.capacity)
        pieces: list = []
        room = sizes.pop(0) if sizes else 0
        for doc_id, start, ids, total in left:
            while ids:
                part = ids[: 4 * room]
                pieces.append((doc_id, start, part, total))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if not room:
                    self.close(pieces, 0)
                    pieces, room = [], sizes.pop(0) if sizes else 0

    def take(self) -> pa.RecordBatch:
        names = [part.split()[0] for part in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def harmonic_pack(
    docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, spare: int = 32, at_once: int = 4096
) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    Lengths fall into reciprocal-capacity classes: class k takes lengths of about
    ``capacity / k`` and its bins are full at k pieces, whatever they hold.  So each
    partition packs by itself, without a shuffle, holding one open bin per class (about
    ``2 * sqrt(capacity)`` classes) in memory.  Documents longer than a sequence fill
    whole ones first; a remainder that fits no class closely is cut into slots.  The
    pieces left in a partition's open bins are laid end to end and closed with sequences
    of power-of-two lengths, which need no padding.

    One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits),
    doc_tokens, sequence_id, offset, bin_class (0: laid end to end).  A null or empty
    text is the end id alone.  Rows with equal or null ids are documents of their own;
    other columns are not read.  Sequence ids come from the partition's number, so a
    task that runs again gives the same rows.  No rows give no rows.
    """
    file = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(file)
        bins = Bins(TaskContext.get().partitionId() << 36, capacity, spare)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bins.add(doc_id, packed([*model.ids(text.as_py()), end_id]))
                if len(bins.rows) >= at_once:
                    yield bins.take()
        bins.finish()
        yield bins.take()

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bin_class"
    )
