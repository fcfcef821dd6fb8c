"""Key sets before the shuffle, pattern tables, tables dealt out by key, one table over several folders."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck.operators import patterns, reduction
from cohortdeck.plans import funnels
from cohortdeck.session import tune
from cohortdeck.sources import bucketed, federated


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def logs(spark):
    """A third of the rows has one key, some have none."""
    log = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 5000).alias("k"), "id")
    chosen = spark.createDataFrame([(k,) for k in [11, 11, 12, 4999, None, 900000]], "k bigint")
    return log, chosen


@pytest.mark.parametrize("most_words", [4_000_000, 0])
def test_reduced_joins_are_exact(spark, rows, most_words):
    log, chosen = logs(spark)
    wanted = {11, 12, 4999}
    everything = rows(log)
    inside = [r for r in everything if r[0] in wanted]
    assert rows(reduction.reduced_semi_join(log, chosen, ["k"], most_words)) == inside
    assert rows(reduction.reduced_anti_join(log, chosen, ["k"], most_words)) == [r for r in everything if r[0] not in wanted]


def test_few_rows_are_left_to_move(spark):
    log, chosen = logs(spark)
    marked, _, test = reduction.suspects(log, chosen, ["k"])
    assert marked.filter(test).count() < log.count() / 10
    # What the exact join shuffles is the filtered scan.
    assert "_hit" in marked.columns and "BroadcastHashJoin" in plan_of(marked)


def test_reduction_of_empty_tables_and_texts(spark, rows):
    log = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("a", 1)], "k string, n int")
    nobody = spark.createDataFrame([], "k string")
    assert rows(reduction.reduced_semi_join(log, nobody, ["k"])) == []
    assert rows(reduction.reduced_anti_join(log, nobody, ["k"])) == rows(log)
    both = spark.createDataFrame([("a", 1), ("b", 4)], "k string, n int")
    assert rows(reduction.reduced_semi_join(log, both, ["k", "n"])) == [("a", 1), ("a", 1)]
    assert rows(reduction.reduced_anti_join(log.limit(0), both, ["k"])) == []


def like(pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return re.compile(out, re.S)


def test_five_thousand_patterns_against_brute_force(spark, rows):
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abc%_"[:3]) for _ in range(n))
    texts = [word(pick.randint(0, 14)) for _ in range(400)] + ["x%y", "x_y", "aéb", "", "a" * 5000]
    shapes = ["{0}%", "%{0}", "%{0}%", "{0}_{1}", "_{0}%", "{0}%{1}", "%{0}_{1}%", "{0}"]
    given = [(pick.choice(shapes).format(word(pick.randint(5, 9)), word(pick.randint(1, 3))), pick.randint(1, 50)) for _ in range(5000)]
    given += [("x\\%y", 1), ("x\\_%", 2), ("___", 60), ("a_b", 3), ("%", 99), ("", 4), (None, 0), ("a%", 50)]
    given = [(p, r, f"{p}#{r}") for p, r in given]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    table = spark.createDataFrame(given, "pattern string, rank int, label string")
    found = patterns.pattern_classes(frame, "t", table, "pattern", "rank", "label")

    tests = [(like(p), (r, p, label)) for p, r, label in given if p is not None]

    def first(text):
        hits = [hit for test, hit in tests if text is not None and test.fullmatch(text)]
        return min(hits)[2] if hits else None

    assert sorted(map(str, rows(found))) == sorted(str((t, first(t))) for t in [*texts, None])
    text = plan_of(found)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_patterns_without_case_or_at_all(spark, rows):
    frame = spark.createDataFrame([("MASS one",), ("two",), ("two",)], "t string")
    table = spark.createDataFrame([("%mass%", 1, "Session"), ("TW_", 2, None)], "p string, r int, l string")
    assert rows(patterns.pattern_classes(frame, "t", table, "p", "r", "l", ignore_case=True)) == rows(
        spark.createDataFrame([("MASS one", "Session"), ("two", None), ("two", None)], "t string, class string")
    )
    assert [r[1] for r in rows(patterns.pattern_classes(frame, "t", table.limit(0), "p", "r", "l"))] == [None] * 3


def test_dealt_funnel_moves_only_its_totals(spark, rows, unbroadcast):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    viewers = spark.createDataFrame([(u, f"s{s}", "ab"[u % 2]) for u in range(40) for s in range(2)] + [(99, "s0", None)], "user_id bigint, session_id string, cohort string")
    views = spark.createDataFrame([(u, "s0", at(u % 7)) for u in range(0, 40, 2) for _ in range(3)], "user_id bigint, session_id string, ts timestamp_ntz")
    bought = spark.createDataFrame([(u, "s0", at(5)) for u in range(0, 40, 3)], "user_id bigint, session_id string, ts timestamp_ntz")
    cash = spark.createDataFrame([(u, 2.5) for u in range(0, 40, 3)] * 2, "user_id bigint, amount double")
    gone = spark.createDataFrame([(6,), (6,)], "user_id bigint")
    inputs = (viewers, views, bought, cash, gone)
    dealt = funnels.dealt_funnel_tables(funnels.funnel_tables(*inputs, ["cohort"]), 8)
    for fanout in ("reference", "per_user"):
        expected = rows(funnels.conversion_funnel(*inputs, fanout=fanout))
        bucketed.meet_in_buckets(spark)
        found = funnels.funnel_of(dealt, fanout=fanout)
        assert len(re.findall(r"Exchange (?:hash|range|single)", plan_of(found))) <= 4
        assert rows(found) == expected
        tune(spark)


def test_dealt_tables_open_again(spark, rows):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "k bigint, t string")
    stored = bucketed.deal_out(df, "again", "k", 4)
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    assert rows(stored) == rows(df)
    assert rows(bucketed.open_dealt(spark, path, "opened_again", "k bigint, t string", "k", 4)) == rows(df)


def test_federated_table_reads_only_what_is_asked(spark, rows, tmp_path):
    schema = StructType().add("ts", "timestamp_ntz").add("user", "long").add("note", "string")
    members = []
    for year, own in [(2022, "u22"), (2023, "u23"), (2024, "user")]:
        path = f"{tmp_path}/{year}"
        frame = spark.createDataFrame([(datetime(year, m, 1), m) for m in range(1, 13)], f"t{year} timestamp_ntz, {own} int")
        frame.write.parquet(path)
        read = lambda session, path=path: session.read.parquet(path)
        members.append(federated.Source(str(year), read, {"ts": f"t{year}", "user": own}, datetime(year, 1, 1), datetime(year + 1, 1, 1)))
    whole = federated.federated_table(spark, members, schema)
    assert whole.count() == 36 and whole.columns == ["source", "ts", "user", "note"]
    one = whole.filter(F.col("source") == "2023")
    assert plan_of(one).count("FileScan") == 1 and one.count() == 12
    bounded = federated.federated_table(spark, members, schema, "ts", datetime(2022, 11, 1), datetime(2023, 2, 1))
    assert rows(bounded, "source", "user") == [("2022", 11), ("2022", 12), ("2023", 1)]
    text = plan_of(bounded)
    assert text.count("FileScan") == 2 and "GreaterThanOrEqual(t2022" in text and "LessThan(t2023" in text
    assert federated.federated_table(spark, members, schema, "ts", datetime(2030, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        federated.federated_table(spark, [members[0], members[0]], schema)
