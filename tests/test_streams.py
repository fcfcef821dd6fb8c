"""Streaming monitors fed file by file."""

import datetime as dt
import os

from pyspark.sql import functions as F

from cohortdeck.plans import monitoring
from cohortdeck.streaming import monitors

SCHEMA = "ts timestamp_ntz, key string"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def feed(spark, folder, batches):
    """Write one file per batch, older files first."""
    os.makedirs(folder)
    for i, batch in enumerate(batches):
        part = f"{folder}/part-{i}"
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
        os.link(f"{part}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return monitors.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def run(stream, folder):
    return monitors.run_to_files(stream, f"{folder}/out", f"{folder}/state")


def test_counts_equal_batch_and_drop_late_rows(spark, tmp_path, rows):
    batches = [[(at(1), "a"), (at(1), "a"), (at(1, 1), "b")], [(at(3), "a")], [(at(4), "a")], [(at(1), "late"), (at(6), "end")]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    found = run(monitors.bucket_counts(stream, "ts", ["key"]), str(tmp_path))
    on_time = spark.createDataFrame([r for b in batches[:3] for r in b], SCHEMA)
    batch = monitoring.time_bucket_counts(on_time, "ts", "minute", {"key": F.col("key")})
    assert rows(found, "key", "metric_value") == rows(batch, "key", "metric_value")


def test_rolling_alert_overlaps(spark, tmp_path, rows):
    stream = feed(spark, str(tmp_path / "in"), [[(at(1, m), "a") for m in range(0, 12)], [(at(5), "end")]])
    found = run(monitors.rolling_alerts(stream, "ts", ["key"], 10), str(tmp_path))
    starts = [r.window_start.strftime("%H:%M") for r in found.orderBy("window_start").collect()]
    assert starts == ["00:55", "01:00"]


def test_messages_are_reported_once_within_memory(spark, tmp_path, rows):
    batches = [[(at(1), "x"), (at(1, 5), "x")], [(at(2), "x"), (at(2), "y")], [(at(15), "z")], [(at(16), "z")], [(at(20), "x")]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    found = run(monitors.first_seen_messages(stream, "ts", "key", "2 hours"), str(tmp_path))
    assert rows(found, "message_start") == [("x",), ("x",), ("y",), ("z",)]


def test_bursts_start_after_silence(spark, tmp_path, rows):
    batches = [[(at(1), "x"), (at(1, 30), "x")], [(at(3, 29), "x"), (at(2), "y")], [(at(6), "x")], [(at(23), "end")]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    found = run(monitors.message_bursts(stream, "ts", "key", "2 hours"), str(tmp_path))
    expected = [("x", at(1), at(3, 29), 3), ("x", at(6), at(6), 1), ("y", at(2), at(2), 1)]
    assert rows(found, "message_start", "first_ts", "last_ts", "total") == expected
    rest = spark.createDataFrame([r for b in batches[:3] for r in b], SCHEMA)
    assert rows(monitors.message_bursts(rest, "ts", "key", "2 hours"), "message_start", "total") == [("x", 1), ("x", 3), ("y", 1)]


def test_alerts_against_stored_hours(spark, tmp_path, rows):
    """Hours finished by the stream, over two runs, give the alerts of the batch job."""
    log = [(at(h, m), "a") for h, n in ((1, 3), (2, 8), (3, 9), (5, 30)) for m in range(n)] + [(at(4, 59), "b")] * 6
    folder = str(tmp_path / "in")
    store = monitoring.hourly_store(spark, str(tmp_path / "hours"), {"key": "string"})
    for slice_ in ([r for r in log if r[0] < at(3, 5)], [r for r in log if r[0] >= at(3, 5)] + [(at(9), "end")]):
        spark.createDataFrame(slice_, SCHEMA).write.mode("append").parquet(folder)
        stream = monitors.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        found = monitors.run_tiered_alerts(
            stream, "ts", store, str(tmp_path / "out"), str(tmp_path / "state"), new_page=5, catch_all=25, noise=4
        )
    whole = monitoring.hourly_alerts(spark.createDataFrame(log, SCHEMA), "ts", ["key"], new_page=5, catch_all=25, noise=4)
    assert rows(found, "key", "hour_start", "executions", "previous_hour") == rows(whole, "key", "hour_start", "executions", "previous_hour")
    assert found.count() == 3


def test_unseen_messages_renew_on_each_sight(spark, tmp_path, rows):
    log = [(at(1), "x"), (at(1, 30), "x"), (at(3, 29), "x"), (at(2), "y"), (at(6), "x"), (at(8), "x"), (at(8), "y")] + [(at(12), "flood")] * 500
    folder, state = str(tmp_path / "in"), str(tmp_path / "minute-state")
    for low, high in ((0, 3), (3, 7), (7, 24)):
        part = [r for r in log if low <= r[0].hour < high] + ([(at(23), "end")] if high == 24 else [])
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        stream = monitors.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        minutes = monitors.run_to_files(monitors.message_minutes(stream, "ts", "key"), str(tmp_path / "minutes"), state)
        arriving = monitors.file_stream(spark, str(tmp_path / "minutes"), minutes.schema)
        found = run(monitors.unseen_messages(arriving, "2 hours"), str(tmp_path))
    assert minutes.filter("message_start = 'flood'").count() == 1
    assert rows(found.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))) == [
        ("flood", at(12)), ("x", at(1)), ("x", at(6)), ("x", at(8)), ("y", at(2)), ("y", at(8))
    ]
