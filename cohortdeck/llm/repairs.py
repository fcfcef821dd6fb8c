"""Conversations brought back to the form ``(s?(ua)+)?`` of role initials at the least cost.

A row is kept (0), gets the role user or assistant (2), or is deleted (3, the only way for
blank and repeated rows); an empty row of user or assistant may be inserted anywhere (2);
a truncated row that stays costs 1 more.  The edits' initials in order (``K R D I``) are
the audit; of all cheapest ones the ASCII-least counts.

A run of edits is one whole number: its cost in the high digits, its letters in the low
ones, a byte each, from the left, with zeros at the end.  Then the cheapest edits with the
least letters are the smallest number, and the way through a conversation is an integer
minimum over a graph of four states (nothing yet, after system, user, assistant) per row.
Equally dear runs between the same two states never begin one another, as a longer one has
further insertions to pay; so runs of neighbouring blocks of rows may be minimised apart
and joined later.  Blocks hold ``block`` rows; a conversation of any length is spread over
tasks by pieces, and joining pieces in pairs keeps the numbers' lengths in step.

The rows of a conversation go by turn (nulls first), then role and text.  Equal rows are
counted before they move; all but the first are duplicates.  Null roles and texts are one
space, null conversations are one conversation, empty conversations don't exist, and an
empty table gives no rows.  Further columns are not read.  The text of a conversation is
rewritten (and hashed) row after row by one task without being held there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.llm.common import BLANKS, map_batches, staged

NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# Insertions that lead from one state to another; longer ones come back to a state they passed.
INSERTIONS = {(x, x): 0 for x in range(4)} | {
    (NONE, USER): 1, (NONE, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1,
}
BEFORE_USER = (NONE, SYSTEM, ASSISTANT)
BLOCK = 32

Paths = list[tuple[int, bytes] | None]  # the best (cost, letters) from state x to state y at 4 x + y


def scalar(cost: int, letters: bytes, width: int) -> int:
    """Cost in the high digits, letters in ``width`` low bytes from the left."""
    return cost << 8 * width | int.from_bytes(letters.ljust(width, b"\0"), "big")


def parts(value: int, width: int) -> tuple[int, bytes]:
    cost, letters = value >> 8 * width, value & (1 << 8 * width) - 1
    return cost, letters.to_bytes(width, "big").rstrip(b"\0")


@lru_cache(maxsize=None)
def row_edges(initial: int, fault: int) -> list[tuple[int, int, int, bytes]]:
    """The best (from, to, cost, letters) over one row: insertions before it, then its own edit."""
    dear = TRUNCATED_COST * (fault == TRUNCATED)
    edits = [(x, x, DELETE_COST, b"D") for x in range(4)]
    if fault not in (BLANK, DUPLICATE):
        edits += [(x, USER, REROLE_COST + dear, b"R") for x in BEFORE_USER] + [(USER, ASSISTANT, REROLE_COST + dear, b"R")]
        edits += [(NONE, SYSTEM, dear, b"K")] * (initial == SYSTEM - 1) + [(USER, ASSISTANT, dear, b"K")] * (initial == ASSISTANT - 1)
        edits += [(x, USER, dear, b"K") for x in BEFORE_USER if initial == USER - 1]
    best: dict[tuple[int, int], int] = {}
    for (x, middle), inserted in INSERTIONS.items():
        for start, y, cost, letter in edits:
            if start == middle:
                value = scalar(INSERT_COST * inserted + cost, b"I" * inserted + letter, 3)
                best[x, y] = min(value, best.get((x, y), value))
    return [(x, y, *parts(value, 3)) for (x, y), value in best.items()]


def block_paths(rows: list[tuple[int, int]]) -> Paths:
    """The best way over a block of (initial, fault) rows between each two states: integer minima from the last row back."""
    width = 3 * len(rows)
    low = (1 << 8 * width) - 1
    steps = [
        [(x, y, scalar(cost, letters, width), 8 * len(letters)) for x, y, cost, letters in row_edges(initial, fault)]
        for initial, fault in reversed(rows)
    ]
    found: Paths = [None] * 16
    for end in range(4):
        values: list[int | None] = [None] * 4
        values[end] = 0
        for step in steps:
            new: list[int | None] = [None] * 4
            for x, y, head, shift in step:
                value = values[y]
                if value is not None:
                    value = head + (value & ~low) + ((value & low) >> shift)
                    if new[x] is None or value < new[x]:
                        new[x] = value
            values = new
        for x, value in enumerate(values):
            found[4 * x + end] = None if value is None else parts(value, width)
    return found


def joined_paths(a: Paths, b: Paths) -> Paths:
    """The best ways over two neighbouring stretches of rows."""
    width = max((len(p[1]) for p in a if p), default=0) + max((len(p[1]) for p in b if p), default=0)
    found: Paths = [None] * 16
    for x in range(4):
        for y in range(4):
            ways = [(a[4 * x + z], b[4 * z + y]) for z in range(4)]
            ways = [(p[0] + q[0], p[1] + q[1]) for p, q in ways if p and q]
            least = min((cost for cost, _ in ways), default=None)
            cheapest = [way for way in ways if way[0] == least]
            if len(cheapest) > 1:
                cheapest = [parts(min(scalar(*way, width) for way in cheapest), width)]
            found[4 * x + y] = cheapest[0] if cheapest else None
    return found


class Stretch:
    """Paths of a growing run of rows, joined like a binary counter so that equals meet."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, Paths]] = []

    def add(self, paths: Paths, level: int = 0) -> None:
        while self.levels and self.levels[-1][0] <= level:
            before, earlier = self.levels.pop()
            paths, level = joined_paths(earlier, paths), max(before, level) + 1
        self.levels.append((level, paths))

    def whole(self) -> Paths:
        levels = [paths for _, paths in self.levels]
        while len(levels) > 1:
            last = levels.pop()
            levels[-1] = joined_paths(levels[-1], last)
        return levels[0]


def cheapest(paths: Paths) -> tuple[int, str]:
    """Cost and audit of whole conversations, with the insertions after the last row."""
    ends = []
    for state in range(4):
        way = paths[4 * NONE + state]
        inserted = 0 if state == NONE else INSERTIONS[state, ASSISTANT]
        if way:
            ends.append((way[0] + INSERT_COST * inserted, way[1] + b"I" * inserted))
    width = max(len(letters) for _, letters in ends)
    cost, letters = parts(min(scalar(*end, width) for end in ends), width)
    return cost, letters.decode()


def ordered_rows(turns: DataFrame) -> DataFrame:
    """Different rows with their number of copies, in order: ``pos`` grows within and between conversations."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), "copies")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = ("conv_id", "turn", "role", "text")
    return counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, copies, initial, fault) of ordered rows; of several copies all but the first are duplicates."""
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    parts_of = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("conv_id", "role", "text")]
    same = F.unhex(F.sha2(F.concat_ws("", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts_of]), 256))
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    open_end = ~F.right(core, F.lit(1)).isin(".", "!", "?")
    light = rows.select(
        "conv_id", "pos", "turn", "copies", initial.alias("initial"), (core == "").alias("blank"), open_end.alias("open_end"),
        F.when(core != "", same).alias("same"),
    )
    # Blank rows have nothing to meet; each keeps a key of its own, as nulls would all meet in one task.
    light = light.withColumn("same", F.coalesce("same", F.encode(F.col("pos").cast("string"), "UTF-8")))
    repeats = light.groupBy("same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("open_end"), TRUNCATED).otherwise(CLEAN)
    )
    return light.join(repeats.filter("n > 1"), "same", "left").select("conv_id", "pos", "turn", "copies", "initial", fault.alias("fault"))


PIECE = (
    "piece bigint, first_turn bigint, last_turn bigint, turns bigint, first int, last int, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, paths array<struct<cost:bigint,letters:string>>"
)
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and paths of each piece of a conversation."""
    for batch in batches:
        found = []
        for piece, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            stretch, block, faults, illegal, turns, last = Stretch(), [], [0] * 4, 0, [], None
            for row in rows:
                initial, fault, turn = row["initial"], row["fault"], row["turn"]
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
                for copy in range(row["copies"]):
                    fault = DUPLICATE if copy and fault != BLANK else fault
                    illegal += last is not None and (last, initial) not in LEGAL
                    last = initial
                    faults[fault] += 1
                    block.append((initial, fault))
                    if len(block) == BLOCK:
                        stretch.add(block_paths(block))
                        block = []
            if block:
                stretch.add(block_paths(block))
            paths = [way and {"cost": way[0], "letters": way[1].decode()} for way in stretch.whole()]
            ends = (turns[0], turns[-1], len(turns)) if turns else (None, None, 0)
            found.append((piece, *ends, rows[0]["initial"], last, *faults[1:], illegal, paths))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _PIECE_FIELDS, strict=True)] if found else None
        if columns:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", *(f.name for f in _PIECE_FIELDS)])


_WAY = pa.list_(pa.struct([("cost", pa.int64()), ("letters", pa.string())]))
_PIECE_FIELDS = [
    *(pa.field(n, pa.int64()) for n in ("piece", "first_turn", "last_turn", "turns")), pa.field("first", pa.int32()), pa.field("last", pa.int32()),
    *(pa.field(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")), pa.field("paths", _WAY),
]
AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    done: list[tuple] = []
    conv: tuple | None = None

    def finish() -> None:
        cost, audit = cheapest(stretch.whole())
        gaps = ends[1] - ends[0] + 1 - ends[2] if ends else 0
        done.append((*conv, gaps, *counts, cost, audit))

    def out(kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string()]
        rows = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(rows, names)

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for row in batch.to_pylist():
            if conv != (row["conv_id"],):
                if conv is not None:
                    finish()
                conv, stretch, ends, counts, last = (row["conv_id"],), Stretch(), None, [0] * 4, None
            if row["first_turn"] is not None:
                same = ends is not None and ends[1] == row["first_turn"]
                ends = (ends[0] if ends else row["first_turn"], row["last_turn"], row["turns"] - same + (ends[2] if ends else 0))
            counts = [n + row[c] for n, c in zip(counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            counts[3] += last is not None and (last, row["first"]) not in LEGAL
            last = row["last"]
            stretch.add([way and (way["cost"], way["letters"].encode()) for way in row["paths"]])
        if len(done) > 5_000:
            yield out(kind)
    if conv is not None:
        finish()
        yield out(kind)


def audits(rows: DataFrame, piece_bits: int = 12) -> DataFrame:
    """conv_id, gaps, fault counts, cost and audit of every conversation with rows.

    A piece is what a conversation has of 2^``piece_bits`` places in the order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    facts = F.sort_array(F.collect_list(F.struct("pos", "turn", "copies", "initial", "fault"))).alias("rows")
    pieces = marked(rows).groupBy("conv_id", F.shiftright("pos", piece_bits).alias("piece")).agg(facts)
    measured = map_batches(pieces, _pieces, f"conv_id {kind}, {PIECE}")
    ordered = measured.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return map_batches(ordered, _audits, f"conv_id {kind}, {AUDIT}")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of conversations: each comes as its audit, then its rows in order."""
    conv: tuple | None = None
    state = audit = at = place = None
    found: list[tuple] = []

    def give(role: str, text: str) -> None:
        nonlocal state, place
        state = NONE if role[:1] not in ("s", "u", "a") else 1 + INITIALS.index(role[:1])
        found.append((*conv, place, role, text))
        place += 1

    def insertions() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            give(expected(), "")
            at += 1

    def expected() -> str:
        return "assistant" if state == USER else "user"

    def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if found:
            types = [kind, pa.int64(), pa.string(), pa.string()]
            rows = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            found.clear()
            yield pa.RecordBatch.from_arrays(rows, ["conv_id", "place", "role", "text"])

    kind, letters = None, 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for own, _, row_audit, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row_audit is not None:
                if conv is not None:
                    insertions()
                conv, state, audit, at, place = (own,), NONE, row_audit, 0, 0
                continue
            for _ in range(copies):
                insertions()
                edit = audit[at]
                at += 1
                if edit != "D":
                    give(role if edit == "K" else expected(), text)
                    letters += len(text)
            if letters > 8_000_000 or len(found) > 10_000:
                yield from out(kind)
                letters = 0
        yield from out(kind)
    if conv is not None:
        insertions()
        yield from out(kind)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) after the edits of ``audits``, conversation by conversation in each partition."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    empty = F.lit(None)
    heads = found.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), "audit", *(empty.cast("string").alias(c) for c in ("role", "text")), empty.cast("bigint").alias("copies"))
    body = rows.select("conv_id", "pos", empty.cast("string").alias("audit"), "role", "text", "copies")
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return map_batches(stream, _rewritten, f"conv_id {kind}, place bigint, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of a table of (conv_id, turn, role, text); a column ``copies`` counts repeats of a row."""
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1).cast("bigint"))
    rows = staged(ordered_rows(turns), "turns")
    found = staged(audits(rows), "audits")
    return found, repaired_turns(rows, found)
