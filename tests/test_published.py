"""Versions, failed writes, and counts that arrive in batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck.plans import monitoring
from cohortdeck.sources.published import Increments, Published, SchemaChanged

SCHEMA = StructType().add("k", "string").add("n", "long")


def table(spark, tmp_path, schema=SCHEMA):
    return Published(spark, str(tmp_path / "table"), schema)


def some(spark, *rows):
    return spark.createDataFrame(rows, "k string, n bigint")


def test_versions_stay_readable(spark, tmp_path, rows):
    t = table(spark, tmp_path)
    assert t.entries() == [] and t.latest() is None
    with pytest.raises(LookupError):
        t.read()
    t.publish(some(spark, ("a", 1)))
    old = t.read()
    t.publish(some(spark, ("a", 2), ("b", 3)))
    assert rows(old) == rows(t.read(1)) == [("a", 1)]
    assert rows(t.read(names={"n": "count"}), "k", "count") == [("a", 2), ("b", 3)]
    with pytest.raises(LookupError):
        t.read(7)


def test_a_failed_write_is_never_seen(spark, tmp_path, rows):
    t = table(spark, tmp_path)
    t.publish(some(spark, ("a", 1)))
    broken = spark.range(0, 1000, 1, 8).select(
        F.lit("x").alias("k"), F.when(F.col("id") == 900, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("bigint").alias("n")
    )
    with pytest.raises(Exception, match="half-way"):
        t.publish(broken)
    assert rows(t.read()) == [("a", 1)] and t.latest() == 1
    t.publish(some(spark, ("a", 5)))
    assert rows(t.read()) == [("a", 5)]


def test_another_schema_is_an_error(spark, tmp_path):
    table(spark, tmp_path).publish(some(spark, ("a", 1)))
    with pytest.raises(SchemaChanged):
        table(spark, tmp_path, StructType.fromDDL("k string, n int")).read()
    with pytest.raises(ValueError):
        table(spark, tmp_path, StructType.fromDDL("k string, other int")).publish(some(spark, ("a", 1)))


def test_batches_add_up_once(spark, tmp_path, rows):
    sums = Increments(table(spark, tmp_path))
    assert sums.append(some(spark, ("a", 1), ("a", 2), (None, 4)), 1)
    assert sums.append(some(spark, ("b", 5)), 2)
    assert not sums.append(some(spark, ("a", 100)), 1)
    assert sums.append(some(spark, ("a", 10), (None, 1)), 3)
    whole = [(None, 5), ("a", 13), ("b", 5)]
    assert rows(sums.state()) == whole
    sums.compact()
    assert rows(sums.state()) == whole and rows(sums.batch(3)) == [(None, 1), ("a", 10)]
    assert not sums.append(some(spark, ("a", 100)), 3) and sums.append(some(spark, ("a", 1)), 4)
    assert rows(sums.state()) == [(None, 5), ("a", 14), ("b", 5)]


def test_changed_hours_equal_the_whole(spark, tmp_path, rows):
    """After each batch, the alerts among the hours it can alter are those of a full recompute."""
    start = datetime(2024, 1, 1)
    log = [(k, start + timedelta(minutes=(k * 7919) % (60 * 24 * 35)), "hot" if k % 3 == 0 else f"p{k % 5}") for k in range(9000)]
    df = spark.createDataFrame(log, "k int, ts timestamp_ntz, page string")
    store = monitoring.hourly_store(spark, str(tmp_path / "hours"), {"page": "string"})
    limits = {"new_page": 3, "catch_all": 9, "noise": 2}
    late = (F.col("k") % 40 == 0) & (F.col("ts") < "2024-01-20")
    parts = [(F.col("ts") < "2024-01-20") & ~late, late, F.col("ts") >= "2024-01-20"]
    done = F.lit(False)
    for number, part in enumerate(parts):
        monitoring.add_hours(store, df.filter(part), "ts", number)
        done = done | part
        whole = monitoring.hourly_alerts(df.filter(done), "ts", ["page"], **limits)
        columns = ["page", "hour_start", "executions", "previous_hour", "yesterday", "weekly_average"]
        assert rows(monitoring.stored_alerts(store, **limits), *columns) == rows(whole, *columns)
        changed = store.batch(number)
        hours = monitoring.touched_hours(changed, ["page"])
        expected = whole.join(hours, ["page", "hour_start"], "left_semi")
        assert rows(monitoring.stored_alerts(store, changed, **limits), *columns) == rows(expected, *columns)
    assert rows(monitoring.stored_alerts(store, changed.limit(0), **limits)) == []
