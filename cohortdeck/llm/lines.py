"""Line dedup: two Bloom filters find suspected repeats, and only those are confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.llm.common import BLANKS, map_batches, staged

SEGMENT = 16  # a filter is merged in segments of 2**SEGMENT bits
AT_ONCE = 1 << 20  # lines summed up in a worker before its sketch leaves
NO_ID = -(1 << 63)  # stands for a null id: the smallest


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased (UTF-8)."""
    return line.strip(BLANKS.encode()).lower()


def keyed_lines(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16-byte digest of the key) of the lines that count."""
    found = []
    for number, line in enumerate(text.split(b"\n") if text else ()):
        key = line_key(line)
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            found.append((number, blake2b(key, digest_size=16).digest()))
    return found


def as_halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def positions(halves: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Filter positions of each digest, one column per hash function."""
    steps = np.arange(hashes, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def filter_bits(rows: int, per_row: int, most: int) -> int:
    """A power of two near ``per_row`` bits a document, at most ``most``."""
    return min(most, 1 << max(SEGMENT, (max(1, rows) * per_row - 1).bit_length()))


def with_id(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("__id"), F.col("text").cast("string").alias("__text"), *columns
    )


def repeat_filter(docs: DataFrame, min_chars: int, bits: int, hashes: int) -> np.ndarray:
    """The twice-seen filter of all line keys, ``bits / 8`` bytes.

    A worker keeps (digest, document) of at most ``AT_ONCE`` lines, finds the keys of one
    and of several documents, and sends their filter positions, two bytes each.  Merging
    streams them by segment: a position that two workers have set once, or one worker
    twice, is set in the twice-seen filter.  So a key of two documents always has all its
    positions there, wherever the documents lie.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        owners: list[int] = []

        def leave() -> pa.RecordBatch:
            halves, ids = as_halves(digests), np.array(owners, np.int64)
            order = np.lexsort((ids, halves[:, 1], halves[:, 0]))
            halves, ids = halves[order], ids[order]
            first = np.r_[True, (halves[1:] != halves[:-1]).any(axis=1)] if len(ids) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            last = ids[np.r_[starts[1:], len(ids)] - 1] if len(ids) else ids
            twice = np.unique(positions(halves[starts][ids[starts] != last], bits, hashes))
            once = np.unique(positions(halves[starts], bits, hashes))
            rows = []
            for kind, found in enumerate((once, twice), 1):
                segments, cuts = np.unique(found >> np.uint64(SEGMENT), return_index=True)
                low = (found & np.uint64((1 << SEGMENT) - 1)).astype("<u2")
                rows += [(int(s), kind, part.tobytes()) for s, part in zip(segments, np.split(low, cuts[1:]))]
            columns = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["segment", "seen", "low"])

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = keyed_lines(text.as_py(), min_chars)
                digests += [d for _, d in found]
                owners += [owner] * len(found)
                if len(owners) >= AT_ONCE:
                    yield leave()
                    digests, owners = [], []
        yield leave()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, times, low in zip(*(c.to_pylist() for c in batch.columns)):
                counts = seen.setdefault(segment, np.zeros(1 << SEGMENT, np.uint8))
                at = np.frombuffer(low, "<u2")
                counts[at] = np.minimum(counts[at] + np.uint8(times), 2)
        rows = [(s, np.packbits(c >= 2).tobytes()) for s, c in seen.items() if (c >= 2).any()]
        columns = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["segment", "bits"])

    sketches = map_batches(with_id(docs), sketch, "segment int, seen int, low binary")
    merged = map_batches(sketches.repartition("segment"), merge, "segment int, bits binary")
    twice = np.zeros(bits // 8, np.uint8)
    width = (1 << SEGMENT) // 8
    found = merged.toArrow()  # in one job; at most bits / 8 bytes, whatever the input
    for segment, part in zip(found["segment"].to_pylist(), found["bits"]):
        twice[segment * width : (segment + 1) * width] = np.frombuffer(part.as_buffer(), np.uint8)
    return twice


def suspects(docs: DataFrame, twice: np.ndarray, min_chars: int, bits: int, hashes: int) -> DataFrame:
    """Lines whose key is in the twice-seen filter: k1, k2, __id, __hash of the text and line numbers per document."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            owners, digests, numbers = [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                found = keyed_lines(text.as_py(), min_chars)
                owners += [row] * len(found)
                numbers += [n for n, _ in found]
                digests += [d for _, d in found]
            halves = as_halves(digests)
            at = positions(halves, bits, hashes)
            hit = (known[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=1)
            lines: dict[tuple[int, bytes], list[int]] = {}
            for k in np.flatnonzero(hit).tolist():
                lines.setdefault((owners[k], digests[k]), []).append(numbers[k])
            rows = pa.array([row for row, _ in lines], pa.int64())
            keys = as_halves([d for _, d in lines]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0).take(rows), batch.column(2).take(rows),
                    pa.array(list(lines.values()), pa.list_(pa.int32())),
                ],
                ["k1", "k2", "__id", "__hash", "lines"],
            )

    source = with_id(docs, F.xxhash64("text").alias("__hash"))
    return map_batches(source, run, "k1 bigint, k2 bigint, __id bigint, __hash bigint, lines array<int>")


def dedup_lines(
    docs: DataFrame, min_chars: int = 10, bits_per_row: int = 128, most_bits: int = 1 << 28, hashes: int = 2
) -> DataFrame:
    """Drop every line that another document with a smaller id has too.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of at
    least ``min_chars`` code points that occur in two documents or more lose all their
    lines except in the smallest doc_id that holds them; other lines stay, in order.

    First pass: the twice-seen filter (``repeat_filter``), at most ``most_bits / 8`` bytes
    whatever the input; where more lines come than it is made for, more of them are
    suspected and the result is the same.  Second pass: suspected lines are confirmed by
    the smallest and the largest document of their 128-bit key, summed before the
    shuffle, so a line that all documents share is no heavier than others.  Then the
    numbers of the dropped lines meet their documents.

    The result has the columns of ``docs`` with text (never null) replaced, and
    __n_lines and __n_dropped.  A null or empty text is one empty line.  A null id is the
    smallest id.  Rows that share an id are one document: their common lines stay in all
    of them.  Extra columns pass through, whatever their names (save those two).
    """
    bits = filter_bits(docs.count(), bits_per_row, most_bits)
    twice = repeat_filter(docs, min_chars, bits, hashes)
    found = staged(suspects(docs, twice, min_chars, bits, hashes), "suspected-lines")
    ends = found.groupBy("k1", "k2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    confirmed = ends.filter("__first < __last").select("k1", "k2", "__first")
    losing = found.join(confirmed, ["k1", "k2"]).filter("__id > __first")
    # Equal rows report the same lines, so the numbers are made distinct.
    drops = losing.groupBy(F.col("__id").alias("__drop_id"), F.col("__hash").alias("__drop_hash")).agg(
        F.array_distinct(F.flatten(F.collect_list("lines"))).alias("__drop")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__own_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
    keyed = keyed.withColumn("__own_hash", F.xxhash64("text"))
    same = (F.col("__own_id") == F.col("__drop_id")) & (F.col("__own_hash") == F.col("__drop_hash"))
    met = keyed.join(drops.hint("shuffle_hash"), same, "left")
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    out = met.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__drop").isNull(), text).otherwise(kept))
    columns = [F.col("__kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    dropped = F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop"))
    return out.select(*columns, F.size("__lines").cast("bigint").alias("__n_lines"), dropped.cast("bigint").alias("__n_dropped"))
