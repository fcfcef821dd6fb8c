"""Conversation repair against trying all edits, and the damage query on odd rows."""

import hashlib
import random
import re
from itertools import product

import pytest

from cohortdeck.llm import damage, repairs

FORM = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """(cost, audit) over all edits with up to two insertions at each place."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        for gaps in product(range(3), repeat=len(rows) + 1):
            if sum(gaps) > 4:
                continue
            audit, cost, out = "I" * gaps[0], 2 * sum(gaps), ["?"] * gaps[0]
            for (initial, fault), edit, gap in zip(rows, edits, gaps[1:], strict=True):
                if edit != "D" and fault in (repairs.BLANK, repairs.DUPLICATE):
                    break
                cost += {"K": 0, "R": 2, "D": 3}[edit] + (edit != "D" and fault == repairs.TRUNCATED)
                out += ["sua?"[initial] if initial < 3 else "x"] * (edit == "K") + ["?"] * (edit == "R") + ["?"] * gap
                audit += edit + "I" * gap
            else:
                # What is rerolled or inserted is user or assistant, whichever fits.
                if any(FORM.fullmatch(filled(out, shift)) for shift in (0, 1)):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def filled(out, shift):
    return "".join("ua"[(k + shift) % 2] if x == "?" else x for k, x in enumerate(out))


@pytest.mark.parametrize("block", [1, 2, 32])
def test_least_edits(block):
    rnd = random.Random(block)
    for _ in range(120):
        rows = [(rnd.randrange(4), rnd.randrange(4)) for _ in range(rnd.randint(1, 4))]
        stretch = repairs.Stretch()
        for k in range(0, len(rows), block):
            stretch.add(repairs.block_paths(rows[k : k + block]))
        assert repairs.cheapest(stretch.whole()) == brute(rows), rows


def test_blocks_make_no_difference():
    rnd = random.Random(9)
    rows = [(rnd.randrange(4), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(700)]
    whole = repairs.cheapest(repairs.block_paths(rows))
    for block in (1, 7, 64):
        stretch = repairs.Stretch()
        for k in range(0, len(rows), block):
            stretch.add(repairs.block_paths(rows[k : k + block]))
        assert repairs.cheapest(stretch.whole()) == whole


def odd_turns(spark):
    rows = [
        (1, None, "user", "first."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"), (1, 1, "assistant", "Hello!"), (1, 5, "user", "Hi."),
        (2, 0, None, None), (2, None, None, "x."), (2, None, None, "x."), (None, 3, "system", "s."), (None, 4, "user", "u"),
        (None, None, None, None), (3, 7, "", ""), (4, 1, "system", "Only."), (5, 2, "user", " \t\n\x0b\x0c\r"),
        (6, 0, "user", "long " * 40_000 + "?"), (6, 1, "assistant", "ünïcode 日本 😀."), (7, 2**62, "user", "a."), (7, -(2**61), "assistant", "b."),
    ]
    rows += [(8, k, ("user", "assistant", "system")[k % 3], f"text {k % 50}.") for k in range(6000)]
    rows += [(9 + k, 0, "user", "x.") for k in range(60)]
    return spark.createDataFrame(rows * 2, TURNS)


def test_odd_turns_match_sql(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "conversations.parquet")
    small = odd_turns(spark).filter("conv_id IS NULL OR conv_id <> 8 OR turn < 60")
    small.coalesce(1).write.parquet(path)
    df = damage.repair_digest(spark.read.parquet(path).withColumn("copies", damage.F.lit("x")).withColumn("pos", damage.F.lit(1)))
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({damage.SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, theirs))


def test_long_conversation_in_pieces(spark):
    turns = odd_turns(spark).filter("conv_id = 8").select("conv_id", "turn", "role", "text")
    rows = repairs.staged(repairs.ordered_rows(turns.withColumn("copies", damage.F.lit(1).cast("bigint"))), "turns")
    expected = [tuple(r) for r in repairs.audits(rows, 30).collect()]
    assert [tuple(r) for r in repairs.audits(rows, 5).collect()] == expected
    assert expected[0][2:4] == (0, 12_000 - 150)


def test_repaired_turns_have_the_form(spark):
    found, turns = repairs.repair(odd_turns(spark).select("conv_id", "turn", "role", "text"))
    by_conversation = {}
    for row in turns.orderBy("conv_id", "place").collect():
        by_conversation.setdefault(row["conv_id"], []).append(row["role"][:1])
    assert by_conversation and all(FORM.fullmatch("".join(x)) for x in by_conversation.values())
    kept = {r["conv_id"]: len(r["audit"].replace("D", "")) for r in found.collect()}
    assert {c: n for c, n in kept.items() if n} == {c: len(x) for c, x in by_conversation.items()}


def test_empty_table(spark):
    assert damage.repair_digest(spark.createDataFrame([], TURNS)).collect() == []


def test_nothing_left(spark):
    """Conversations whose rows are all dropped: zeros and the hash of nothing."""
    df = spark.range(200).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'x.' AS text")
    rows = {r["conv_id"]: r for r in damage.repair_digest(df).collect()}
    left = {r["conv_id"] for r in damage.damaged(df).collect()}
    gone = [r for c, r in rows.items() if c not in left]
    assert len(rows) == 200 and gone
    assert all((r["cost"], r["audit"], r["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest()) for r in gone)
