"""Latest rows and interval pairs against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortdeck.operators import asof

START = datetime(2024, 1, 1)
HISTORY = "u int, since timestamp_ntz, until timestamp_ntz, plan string, fee int"
POINTS = "p int, u int, ts timestamp_ntz"
SPANS = "i int, u int, a timestamp_ntz, b timestamp_ntz"


def moments(seed, n):
    """Times of a hot user and a few others, with ties, nulls and borders of cells."""
    rnd = random.Random(seed)
    for k in range(n):
        user = rnd.choice([1, 1, 1, 2, 3, None])
        at = START + timedelta(hours=rnd.randrange(24 * 40), seconds=rnd.choice([0, 0, 1, 3599]))
        yield k, user, rnd.choice([at, at, at, None])


@pytest.mark.parametrize("grain", ["hour", "day", "month"])
@pytest.mark.parametrize("until", [None, "until"])
def test_latest_row_equals_a_loop(spark, grain, until):
    rnd = random.Random(4)
    history = [
        (u, at, rnd.choice([None, at + timedelta(hours=rnd.choice([1, 30, 200]))]) if at else None, rnd.choice([None, "a", "b"]), k)
        for k, u, at in moments(1, 300)
    ]
    history += history[:50]
    points = list(moments(2, 400))
    df = asof.asof_attributes(
        spark.createDataFrame(points, POINTS), "ts", spark.createDataFrame(history, HISTORY), "since", ["u"], ["plan", "fee"], until, grain=grain
    )
    expected = []
    for p, u, ts in points:
        rows = [h for h in history if u is not None and ts is not None and h[0] == u and h[1] is not None and h[1] <= ts]
        order = lambda h: (h[1], h[3] is not None, h[3] or "", h[4])
        held = max(rows, key=order, default=None)
        if until and held and held[2] is not None and held[2] <= ts:
            held = None
        expected.append((p, u, ts, held is not None, *(held[3:] if held else (None, None))))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))
    assert "Broadcast" not in "".join(df.columns) and df.columns == ["p", "u", "ts", "found", "plan", "fee"]


def test_taken_names_are_an_error(spark):
    df = spark.createDataFrame([], POINTS)
    with pytest.raises(ValueError):
        asof.asof_attributes(df, "ts", df, "ts", ["u"], ["p"])


def cells_of(spark, first, last, levels):
    (row,) = spark.range(1).select(asof.interval_cells(F.lit(first), F.lit(last), levels).alias("c")).collect()
    return [(c["level"], c["place"]) for c in row["c"]]


def test_cells_cover_each_number_once(spark):
    rnd = random.Random(8)
    for _ in range(25):
        first = rnd.randrange(-300, 300)
        last = first + rnd.randrange(200)
        cells = cells_of(spark, first, last, 4)
        covered = sorted(n for level, place in cells for n in range(place << level, (place + 1) << level))
        assert covered == list(range(first, last + 1))
        assert all(sum(level == k for level, _ in cells) <= 2 for k in range(4))


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("unit, levels", [(60, 12), (3600, 3), (1, 0)])
def test_pairs_equal_a_loop(spark, closed, unit, levels):
    rnd = random.Random(5)
    points = list(moments(6, 150))
    far = 500 if levels else 2
    spans = [(k, u, at, at + timedelta(seconds=rnd.choice([0, 1, 59, 3600, 3600 * far, -5])) if at else None) for k, u, at in moments(7, 120 if levels else 40)]
    if not levels:
        spans = [(k, u, a, b if b is None or b - a < timedelta(minutes=2) else a + timedelta(seconds=59)) for k, u, a, b in spans]
    df = asof.interval_pairs(
        spark.createDataFrame(points, POINTS), "ts", spark.createDataFrame(spans, SPANS), F.col("a"), F.col("b"), ["u"], closed, unit, levels
    )
    expected = [
        (p, i) for p, u, ts in points for i, v, a, b in spans
        if u is not None and u == v and None not in (ts, a, b) and a <= ts and (ts <= b if closed else ts < b) and a <= b
    ]
    assert sorted((r["p"], r["i"]) for r in df.collect()) == sorted(expected)


def test_a_hot_user_is_spread(spark):
    """All rows of one user: they still go to many tasks."""
    points = spark.range(20_000).selectExpr("id AS p", "1 AS u", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts")
    spans = points.selectExpr("p AS i", "u", "ts AS a", "ts + INTERVAL 5 MINUTES AS b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = asof.interval_pairs(points, "ts", spans, F.col("a"), F.col("b"), ["u"])
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == sum(min(6, k + 1) for k in range(20_000))
        assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
