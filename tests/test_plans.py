"""What the physical plans may and may not contain."""

import pytest

import __spark_entry__ as entry
from cohortdeck.checks.entities import Tables
from cohortdeck.checks.registry import QUERIES
from cohortdeck.operators import filters, joins
from cohortdeck.plans import monitoring

SF_DIR = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.endswith("_stream"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "isNullAwareAntiJoin", "Python"):
        assert bad not in text


@pytest.mark.parametrize(
    "name, scans", [("conversion_funnel", 8), ("message_test", 6), ("hot_items", 1), ("hourly_tiered_alert", 1), ("top_messages", 1)]
)
def test_log_scans_do_not_multiply(spark, name, scans):
    """Steps that share an input share its shuffle once the query runs."""
    df = entry.queries()[name](spark, SF_DIR)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= scans


def test_distinct_counts_repeat_no_rows(spark):
    assert "Expand " not in plan(entry.queries()["conversation_outcomes"](spark, SF_DIR))


def test_windows_reach_the_scan(spark):
    t = Tables(spark, SF_DIR)
    text = plan(filters.closed_days(t.events, "ts", "2024-01-31 05:00:00", 7).select("event_type"))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in text and "LessThan(ts,2024-01-31T00:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    text = plan(filters.rolling_window(t.events, "ts", "2024-01-31 00:20:00", 20))
    assert "GreaterThanOrEqual(ts,2024-01-31T00:00)" in text


def test_one_hour_alert_reads_only_its_hours(spark):
    t = Tables(spark, SF_DIR)
    text = plan(monitoring.hourly_alerts(t.events, "ts", ["event_type"], "2024-01-30 10:00:00"))
    assert "GreaterThanOrEqual(ts,2024-01-02T10:00)" in text and "LessThan(ts,2024-01-30T11:00)" in text


def test_large_sides_are_not_broadcast(spark):
    """Without small sides the same joins run as shuffles, null-aware ones too."""
    t = Tables(spark, SF_DIR)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.not_in(t.events, "user_id", t.orders, "o_custkey"))
        assert "Broadcast" not in text and "SortMergeJoin" in text
        for name in ("conversion_funnel", "new_messages", "robust_outliers", "events_in_interval"):
            assert "Broadcast" not in plan(entry.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
