"""Counts and sums far larger than the test tables have, refunds, and groups in the tail."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortdeck.operators import baselines, selection, timeline
from cohortdeck.plans import activity, cohorts, experiments, monitoring, sales

BIG = 10**12


def at(hour):
    return datetime(2024, 1, 1, hour)


def test_refunds_are_subtracted(spark, rows):
    points = spark.createDataFrame([(1, at(1), -5), (1, at(2), 2), (1, at(3), -1)], "u int, ts timestamp_ntz, w bigint")
    spans = spark.createDataFrame(
        [(1, 1, at(1), at(2)), (2, 1, at(3), at(3)), (3, 1, at(3), at(1)), (4, None, at(1), at(3)), (5, 1, None, at(3))],
        "i int, u int, a timestamp_ntz, b timestamp_ntz",
    )
    sums = timeline.interval_sums(spans, ["i"], F.col("a"), F.col("b"), points, "ts", ["u"], {"w": F.col("w")})
    assert rows(sums, "i", "w") == [(1, -3), (2, -1), (3, 0), (4, 0), (5, 0)]


def test_doubles_are_refused(spark):
    points = spark.createDataFrame([(1, at(1), 1e16), (1, at(2), 1.0)], "u int, ts timestamp_ntz, w double")
    with pytest.raises(TypeError):
        timeline.interval_sums(points, ["ts"], F.col("ts"), None, points, "ts", ["u"], {"w": F.col("w")})


def test_points_without_time_count_nowhere(spark, rows):
    points = spark.createDataFrame([(1, None, 7), (1, at(2), 2)], "u int, ts timestamp_ntz, w bigint")
    spans = spark.createDataFrame([(1, 1, None, at(3)), (2, 1, at(1), at(3))], "i int, u int, a timestamp_ntz, b timestamp_ntz")
    sums = timeline.interval_sums(spans, ["i"], F.col("a"), F.col("b"), points, "ts", ["u"], {"w": F.col("w")})
    assert rows(sums, "i", "w") == [(1, 0), (2, 2)]


def test_price_test_with_refunds(spark, rows):
    buyers = spark.createDataFrame([(1, at(1), Decimal("10.00"), "a"), (2, at(1), Decimal("20.00"), "a")], "user_id int, first_ts timestamp_ntz, first_amount decimal(18,2), c string")
    trx = spark.createDataFrame(
        [(1, at(1), 10.0, False, True), (1, at(2), -30.0, True, True), (2, at(1), 20.0, False, True), (2, at(3), 5.0, True, True), (2, at(0), 99.0, True, True)],
        "user_id int, ts timestamp_ntz, amount double, is_renewal boolean, is_cash boolean",
    )
    gone = spark.createDataFrame([(1,)], "user_id int")
    found = experiments.price_test_summary(buyers, trx, gone, ["c"])
    assert rows(found, "users", "total_cash", "initial_cash", "renewal_cash", "resignations") == [
        (2, Decimal("5.00"), Decimal("30.00"), Decimal("-25.00"), 1)
    ]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "Window" not in text


def test_large_populations(spark, rows):
    sizes = spark.createDataFrame([("a", BIG), ("b", 3 * BIG)], "g string, n bigint")
    assert rows(activity.population_share(sizes, "g", "n"), "g", "share") == [("a", Decimal("0.250000")), ("b", Decimal("0.750000"))]
    summary = spark.createDataFrame([(0, 1, 4 * BIG), (1, 1, 6 * BIG)], "c int, g int, users bigint")
    lift = experiments.index_to_control(summary, "c", 0, {"users": 0}, "0.75", ["g"], "users")
    assert rows(lift, "c", "users_indexed", "conversion")[1] == (1, Decimal(6 * BIG), Decimal("100.00"))


def test_large_deviations(spark):
    values = [10 * BIG] * 9 + [1]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v bigint")
    low = baselines.low_outliers(df, ["g"], "v").collect()
    assert [r.v for r in low] == [1] and low[0].actual_variance == 10 * BIG - 1
    high = baselines.high_outliers(spark.createDataFrame([("g", 1)] * 9 + [("g", 10 * BIG)], "g string, v bigint"), ["g"], "v", 5).collect()
    assert [r.v for r in high] == [10 * BIG]


def test_rates_of_large_days(spark):
    kinds = dict(sales._with_rates(spark.sql("SELECT 1000000000000L purchases, 1L buyers, 1L new_users")).dtypes)
    row = sales._with_rates(spark.sql("SELECT 1000000000000L purchases, 1L buyers, 1L new_users")).first()
    assert row.rate_new == BIG and kinds["rate_new"] == "decimal(28,3)"


def test_large_cohort_counts_keep_their_type(spark):
    df = spark.sql("SELECT 'a' guid, timestamp_ntz'2024-01-01' ts")
    found = cohorts.dated_cohort_counts(df, "guid", 1, "ts", [("T", "0", "2024-01-01", None)])
    assert dict(found.dtypes)["control_scaled"] == "bigint"
    assert monitoring.hot_items is not None


def test_tail_group_is_cut_into_cells(spark):
    fast = spark.range(60_000).selectExpr("'fast' g", "id % 997 v")
    slow = spark.range(6_000).selectExpr("'slow' g", "100000 + id v")
    counts = fast.union(slow).union(spark.sql("SELECT 'slow' g, 10000000000L v")).groupBy("g", "v").count()
    cells = timeline.value_cells(counts, ["g"], "v").filter("g = 'slow'").groupBy("_cell").count().collect()
    held = sorted(r["count"] for r in cells)
    assert len(held) > 40 and held[-1] < 12 * (6_001 / len(held))


@pytest.mark.parametrize("tiebreak", ["t", "d", "s"])
def test_top_half_with_any_tiebreak(spark, rows, tiebreak):
    df = spark.range(101).selectExpr(
        "int(id) i", "'g' g", "1 v", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id) t", "date_add(date'2020-01-01', int(id)) d", "concat('key-', lpad(id, 4, '0')) s"
    )
    assert rows(selection.top_half(df, ["g"], "v", tiebreak), "i") == sorted(((i,) for i in range(51)), key=lambda r: (True, str(r[0])))


def test_no_group_keys(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 100)], "v bigint")
    spread = baselines.group_spread(df, [], "v").first()
    assert (spread.rows, spread.median) == (5, 3)
    assert [r.v for r in baselines.trim_high(df, [], "v").collect()] == [1, 2, 3, 4]
