"""Operators on hand-made frames, and on skewed data against brute force."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortdeck.operators import aggregates, baselines, calendars, joins, selection, sets, timeline
from cohortdeck.plans import activity


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


# --- joins ------------------------------------------------------------------------


def test_not_in_follows_null_rules(spark, rows):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    known = spark.createDataFrame([("a",)], "y string")
    holed = spark.createDataFrame([("a",), (None,)], "y string")
    empty = spark.createDataFrame([], "y string")
    assert rows(joins.not_in(left, "x", known, "y")) == [("b",)]
    assert rows(joins.not_in(left, "x", holed, "y")) == []
    assert rows(joins.not_in(left, "x", empty, "y")) == [(None,), ("a",), ("b",)]


def test_preceded_by_is_strict_and_single(spark, rows):
    later = spark.createDataFrame([(1, at(3)), (2, at(1)), (3, at(1))], "k int, t timestamp_ntz")
    earlier = spark.createDataFrame([(1, at(1)), (1, at(2)), (2, at(1))], "k int, t timestamp_ntz")
    assert rows(joins.preceded_by(later, "t", earlier, "t", ["k"]), "k") == [(1,)]


def test_first_event_keeps_ties(spark, rows):
    df = spark.createDataFrame([(1, at(1), "a"), (1, at(1), "b"), (1, at(2), "c")], "k int, t timestamp_ntz, v string")
    assert rows(joins.at_first_event(df, ["k"], "t"), "v") == [("a",), ("b",)]


def test_salted_join_equals_plain_join(spark, rows):
    left = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k int, w string")
    for how in ("inner", "left"):
        assert rows(joins.salted_join(left, right, ["k"], 5, how), "k", "v", "w") == rows(
            left.join(right, ["k"], how), "k", "v", "w"
        )
    with pytest.raises(ValueError):
        joins.salted_join(left, right, ["k"], 5, "full")


def test_null_safe_join_matches_nulls(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, w int")
    assert rows(joins.null_safe_join(left, right, ["k"])) == [(None, 1, 10)]


# --- intervals ------------------------------------------------------------------------


def test_interval_bounds(spark, rows):
    points = spark.createDataFrame([(1, at(h)) for h in (9, 10, 11, 12, 13)], "u int, ts timestamp_ntz")
    spans = spark.createDataFrame(
        [("in", 1, at(10), at(12)), ("none", 2, at(10), at(12)), ("hole", 1, None, at(12)), ("back", 1, at(12), at(10))],
        "id string, u int, b timestamp_ntz, e timestamp_ntz",
    )
    closed = timeline.interval_counts(spans, ["id"], F.col("b"), F.col("e"), points, "ts", ["u"], "n")
    assert rows(closed) == [("back", 0), ("hole", 0), ("in", 3), ("none", 0)]
    half = timeline.interval_counts(spans, ["id"], F.col("b"), F.col("e"), points, "ts", ["u"], "n", end_closed=False)
    assert dict(rows(half))["in"] == 2
    onward = timeline.interval_counts(spans.filter("id = 'in'"), ["id"], F.col("b"), None, points, "ts", ["u"], "n")
    assert rows(onward) == [("in", 4)]


def test_validity_bounds(spark, rows):
    points = spark.createDataFrame([("begin", 1, at(10)), ("end", 1, at(12)), ("other", 2, at(11))], "id string, u int, ts timestamp_ntz")
    valid = spark.createDataFrame([(1, at(10), at(12)), (1, at(12), at(12))], "u int, b timestamp_ntz, e timestamp_ntz")
    found = timeline.covering_count(points, "ts", valid, "b", "e", ["u"], "n")
    assert rows(found, "id", "n") == [("begin", 1), ("end", 0), ("other", 0)]


@pytest.mark.parametrize("grain", ["minute", "day", "year"])
def test_intervals_on_a_hot_key_equal_brute_force(spark, grain):
    rng = random.Random(5)
    user = lambda: 0 if rng.random() < 0.4 else rng.randint(1, 20)
    moment = lambda: at(0) + dt.timedelta(minutes=rng.randint(0, 9000))
    points = [(user(), moment()) for _ in range(1500)]
    spans = []
    for i in range(400):
        begin = moment()
        spans.append((i, user(), begin, begin + dt.timedelta(minutes=rng.randint(0, 2000))))
    expected = {i: sum(1 for q, t in points if q == u and b <= t <= e) for i, u, b, e in spans}
    found = timeline.interval_counts(
        spark.createDataFrame(spans, "id int, u int, b timestamp_ntz, e timestamp_ntz"),
        ["id"],
        F.col("b"),
        F.col("e"),
        spark.createDataFrame(points, "u int, ts timestamp_ntz"),
        "ts",
        ["u"],
        "n",
        grain=grain,
    )
    assert {r.id: r.n for r in found.collect()} == expected


@pytest.mark.parametrize("grain", ["minute", "hour"])
def test_intervals_over_a_clock_change(spark, rows, grain):
    """Zone-free times in the hour a session's zone skips keep their order."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2024, 3, 10, h, m) for h in (1, 2, 3) for m in (10, 40)]
        points = spark.createDataFrame([(1, t) for t in times], "u int, ts timestamp_ntz")
        spans = spark.createDataFrame(
            [("gap", 1, dt.datetime(2024, 3, 10, 2), dt.datetime(2024, 3, 10, 3)), ("late", 1, dt.datetime(2024, 3, 10, 3), dt.datetime(2024, 3, 10, 3, 20))],
            "id string, u int, b timestamp_ntz, e timestamp_ntz",
        )
        found = timeline.interval_counts(spans, ["id"], F.col("b"), F.col("e"), points, "ts", ["u"], "n", grain=grain)
        assert rows(found) == [("gap", 2), ("late", 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --- order statistics ---------------------------------------------------------------------


def test_median_of_small_groups(spark, rows):
    data = [("one", 5), ("two", 1), ("two", 4), ("three", 1), ("three", 9), ("three", 2), ("four", 1), ("four", 2), ("four", 5), ("four", 9)]
    df = spark.createDataFrame(data, "g string, v int")
    expected = [("four", 3), ("one", 5), ("three", 2), ("two", 2)]
    for cells in (1, 2, 32):
        assert rows(timeline.exact_median(df, ["g"], "v", cells=cells)) == expected


def test_median_of_fractions_is_not_truncated(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert rows(timeline.exact_median(df, ["g"], "v")) == [("a", 1.5)]


def test_median_of_negative_whole_numbers_truncates_toward_zero(spark, rows):
    df = spark.createDataFrame([("a", -1), ("a", -2)], "g string, v int")
    assert rows(timeline.exact_median(df, ["g"], "v")) == [("a", -1)]


@pytest.mark.parametrize("cells", [1, 4, 32])
def test_median_with_hot_group_and_hot_value(spark, cells):
    rng = random.Random(11)
    groups = defaultdict(list)
    for _ in range(4000):
        group = "hot" if rng.random() < 0.5 else rng.choice("abcdefg")
        groups[group].append(7 if rng.random() < 0.3 else rng.randint(-50, 100000))
    groups[None] = [3, 1, 2]
    data = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v int")
    found = {r.g: r.median for r in timeline.exact_median(df, ["g"], "v", cells=cells).collect()}
    assert found == {g: int(statistics.median_low(vs) + statistics.median_high(vs)) // 2 for g, vs in groups.items()}


def test_top_half_rounds_up_and_cuts_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 1, 12), ("a", 2, 13), ("a", 9, 14), ("b", 1, 20)], "g string, v int, id int")
    assert rows(selection.top_half(df, ["g"], "v", "id"), "id") == [(10,), (11,), (12,), (20,)]
    same = spark.createDataFrame([("a", 1, i) for i in range(7)], "g string, v int, id int")
    assert rows(selection.top_half(same, ["g"], "v", "id"), "id") == [(0,), (1,), (2,), (3,)]


# --- aggregates -------------------------------------------------------------------------


def test_conditional_counts_null_and_zero(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 5)], "g string, v int")
    counted = df.groupBy("g").agg(
        aggregates.count_when_or_null(F.col("v") > 3).alias("plain"), aggregates.count_when(F.col("v") > 3).alias("zero")
    )
    assert rows(counted) == [("a", None, 0), ("b", 1, 1)]


def test_distinct_flags_ignore_null_units(spark, rows):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", None, True), ("b", None, True)], "g string, u int, f boolean")
    found = aggregates.distinct_flag_counts(df, ["g"], "u", "units", {"flagged": F.col("f")})
    assert rows(found) == [("a", 1, 1), ("b", 0, 0)]


def test_pivot_total_equals_unpivoted_total(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4)], "r string, c string, n int")
    wide = aggregates.pivot_sum(df, ["r"], "c", {"x": "x", "y": "y"}, F.col("n"))
    got = {r.r: (r.x, r.y) for r in wide.collect()}
    assert got == {"a": (1, 2), "b": (4, None)}


def test_merged_metrics_sum_per_day(spark, rows):
    one = spark.createDataFrame([(at(1),), (at(2),)], "t timestamp_ntz")
    two = spark.createDataFrame([(at(1, day=2),)], "t timestamp_ntz")
    found = sets.merge_metrics({"made": (one, F.to_date("t")), "seen": (two, F.to_date("t"))})
    assert rows(found) == [(dt.date(2024, 1, 1), 2, 0), (dt.date(2024, 1, 2), 0, 1)]


def test_spine_has_every_day(spark):
    assert calendars.day_spine(spark, "2024-02-27", "2024-03-02").count() == 5


def test_population_share_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "g string, n int")
    assert [float(r.share) for r in activity.population_share(df, "g", "n").collect()] == [0.25, 0.75]


# --- baselines ---------------------------------------------------------------------------


def daily(spark, data):
    return spark.createDataFrame([(k, dt.date(2024, 1, d), v) for k, d, v in data], "k string, day date, v bigint")


def test_whole_number_ratio_needs_a_doubling(spark, rows):
    data = [("up", 1, 100), ("up", 2, 100), ("up", 4, 150), ("double", 1, 100), ("double", 4, 200), ("new", 4, 20), ("quiet", 1, 1), ("quiet", 4, 5)]
    args = (["k"], "day", "v", "2024-01-04", "2024-01-03", 10, 0.2)
    whole = baselines.day_against_average(daily(spark, data), *args)
    assert rows(whole, "k", "on_day", "average") == [("double", 200, 100), ("new", 20, None)]
    exact = baselines.day_against_average(daily(spark, data), *args, decimal_ratio=True)
    assert rows(exact, "k") == [("double",), ("new",), ("up",)]


def test_zero_average_counts_as_unknown(spark, rows):
    data = [("z", 1, 0), ("z", 4, 20)]
    found = baselines.day_against_average(daily(spark, data), ["k"], "day", "v", "2024-01-04", "2024-01-03", 10, 0.2)
    assert rows(found, "k", "average") == [("z", 0)]


@pytest.mark.parametrize(
    "now, week, prev, yest, alarm",
    [
        (1000, None, None, None, False),
        (1001, None, None, None, True),
        (1001, 0, 0, 0, True),
        (401, 200, 0, 0, True),
        (400, 200, 0, 0, False),
        (401, None, 200, None, True),
        (401, 300, 100, 100, False),
        (401, None, None, 200, True),
        (401, None, 300, 100, False),
        (3001, 2900, 2900, 2900, True),
        (3000, 2900, 2900, 2900, False),
        (300, 1, 1, 1, False),
        (301, 1, 1, 1, True),
    ],
)
def test_tiered_alert(spark, now, week, prev, yest, alarm):
    df = spark.createDataFrame([(now, week, prev, yest)], "n int, w int, p int, y int")
    assert df.select(baselines.tiered_alert(F.col("n"), F.col("w"), F.col("p"), F.col("y"))).first()[0] is alarm


def test_single_row_groups_never_flag_and_are_trimmed(spark, rows):
    df = spark.createDataFrame([("solo", 900)] + [("many", v) for v in (10, 10, 10, 11, 200)], "g string, v int")
    assert rows(baselines.high_outliers(df, ["g"], "v", 5, deviations=1), "g", "v") == [("many", 200)]
    assert rows(baselines.low_outliers(df, ["g"], "v"), "v") == []
    assert rows(baselines.trim_high(df, ["g"], "v"), "g", "v") == [("many", v) for v in (10, 10, 10, 11)]


def test_hourly_baselines(spark, rows):
    def calls(day, hour, n):
        return [("p", dt.datetime(2024, 1, day, hour, 5))] * n

    log = calls(1, 10, 8) + calls(8, 10, 4) + calls(21, 10, 3) + calls(22, 9, 5) + calls(22, 10, 7)
    df = spark.createDataFrame(log, "page string, ts timestamp_ntz")
    found = baselines.hourly_baselines(df, "ts", ["page"]).filter(F.col("hour_start") == dt.datetime(2024, 1, 22, 10))
    assert rows(found, "executions", "previous_hour", "yesterday", "weekly_average") == [(7, 5, 3, 6)]
