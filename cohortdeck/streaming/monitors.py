"""Monitors on a stream: the same counts and alerts without polling.

Each function takes a streaming (or batch) frame and returns one; the caller picks
source, sink and trigger.  State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.texts import slice_text
from cohortdeck.plans.monitoring import stored_alerts
from cohortdeck.sources.published import Increments


def file_stream(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(folder)


def _timed(rows: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone; zone-free times are read in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def bucket_counts(
    events: DataFrame, ts: str, keys: Sequence[str | Column], width: str = "1 minute", late: str = "10 minutes"
) -> DataFrame:
    """Counts per tumbling window and key; rows later than ``late`` are not counted."""
    return (
        _timed(events, ts)
        .withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("metric_value"))
        .withColumn("window_start", F.col("_w.start"))
        .drop("_w")
    )


def rolling_alerts(
    events: DataFrame,
    ts: str,
    keys: Sequence[str],
    min_count: int,
    width: str = "20 minutes",
    slide: str = "5 minutes",
    late: str = "10 minutes",
) -> DataFrame:
    """Sliding windows in which a key occurs more than ``min_count`` times."""
    return (
        _timed(events, ts)
        .withWatermark(ts, late)
        .groupBy(F.window(ts, width, slide).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("metric_value"))
        .filter(F.col("metric_value") > min_count)
        .select(F.col("_w.start").alias("window_start"), *keys, "metric_value")
    )


def first_seen_messages(
    log: DataFrame, ts: str, message: str, memory: str = "6 hours", prefix: tuple[int, int] = fixed.MESSAGE_PREFIX
) -> DataFrame:
    """The first row of each message beginning; repeats inside ``memory`` are dropped."""
    return (
        _timed(log, ts)
        .withWatermark(ts, memory)
        .withColumn("message_start", slice_text(F.col(message), *prefix))
        .dropDuplicatesWithinWatermark(["message_start"])
    )


def message_bursts(
    log: DataFrame,
    ts: str,
    message: str,
    quiet: str = "5 hours",
    late: str = "10 minutes",
    prefix: tuple[int, int] = fixed.MESSAGE_PREFIX,
) -> DataFrame:
    """Every time a message beginning shows up after being unseen for ``quiet``.

    One row per burst with its first and last time and its rows.  The exact record to
    ``first_seen_messages``' early warning: a stream hands a burst out once it is over.
    Rows closer than ``quiet`` belong together, so a batch is first summed per message
    and stretch of that length, and a message met everywhere shrinks before it moves.
    """
    rows = _timed(log, ts).select(ts, slice_text(F.col(message), *prefix).alias("message_start"))
    first, last, total = F.min("_first").alias("first_ts"), F.max("_last").alias("last_ts"), F.sum("_n").alias("total")
    if log.isStreaming:
        single = rows.withWatermark(ts, late).select("*", *[F.col(ts).alias(n) for n in ("_first", "_last")], F.lit(1).alias("_n"))
        return single.groupBy(F.session_window(ts, quiet).alias("_s"), "message_start").agg(first, last, total).drop("_s")
    stretches = rows.groupBy(F.window(ts, quiet).alias("_w"), "message_start").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    length = (F.unix_micros("_last") - F.unix_micros("_first")).cast("string")
    gap = F.concat(length, F.lit(f" microseconds {quiet}"))
    return stretches.groupBy(F.session_window("_first", gap).alias("_s"), "message_start").agg(first, last, total).drop("_s")


def run_tiered_alerts(
    events: DataFrame, ts: str, store: Increments, out: str, checkpoint: str, late: str = "10 minutes", **thresholds: int
) -> DataFrame:
    """Alarming hours of a stream, each as soon as it is complete; processes what is there.

    An hour is complete when the watermark has passed it.  Its counts are then added to the
    stored hours, whose older hours are its baselines, so the stream itself keeps only open
    hours.  A micro-batch that is run again is known to the store by its number and writes the
    same folder, so nothing is counted or warned of twice.
    """
    spark = events.sparkSession
    keys = [k for k in store.keys if k != "hour_start"]
    kinds = {f.name: f.dataType for f in store.table.schema}
    counts = bucket_counts(events, ts, keys, "1 hour", late)

    def finish(batch: DataFrame, number: int) -> None:
        hours = batch.select(*keys, F.col("window_start").cast("timestamp_ntz").alias("hour_start"), F.col("metric_value").alias("executions"))
        store.append(hours, number)
        done = store.batch(number)
        alerts = stored_alerts(store, done, **thresholds).join(done.select(*store.keys), store.keys, "left_semi")
        alerts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counts.writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [f"`{k}` {kinds[k].simpleString()}" for k in store.keys]
    schema = ", ".join([*kept, "executions bigint", "previous_hour bigint", "yesterday bigint", "weekly_average bigint"])
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


SEEN = "message_start string, first_ts timestamp"
LAST = "last_seen bigint"


def message_minutes(
    log: DataFrame, ts: str, message: str, late: str = "10 minutes", prefix: tuple[int, int] = fixed.MESSAGE_PREFIX
) -> DataFrame:
    """The first and last time of each message beginning in each minute, when the minute is complete."""
    rows = _timed(log, ts).select(ts, slice_text(F.col(message), *prefix).alias("message_start"))
    return (
        rows.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 minute").alias("_w"), "message_start")
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select("message_start", F.col("_w.start").alias("minute"), "first_ts", "last_ts")
    )


def unseen_messages(minutes: DataFrame, quiet: str = "5 hours", late: str = "10 minutes") -> DataFrame:
    """Messages at the moment they turn up after being unseen for ``quiet``.

    Takes the stored ``message_minutes`` as a stream, so a flooding message reaches its keyed
    state as one row a minute.  The state is the time it was last seen; it is renewed on each
    sight and dropped ``quiet`` later.  A row comes out once its minute is complete, unlike
    those of ``message_bursts``, which wait for the burst's end.
    """
    rows = minutes.withWatermark("minute", late).select(
        "message_start", "minute", F.unix_micros("first_ts").alias("first"), F.unix_micros("last_ts").alias("last")
    )
    gap = pd.Timedelta(quiet) // pd.Timedelta(microseconds=1)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(frames).sort_values("first")
        seen = state.get[0] if state.exists else None
        shown = []
        for first, last in zip(found["first"].tolist(), found["last"].tolist(), strict=True):
            if seen is None or first - seen >= gap:
                shown.append((key[0], first))
            seen = last if seen is None else max(seen, last)
        state.update((seen,))
        state.setTimeoutTimestamp(max(seen + gap, state.getCurrentWatermarkMs() * 1000) // 1000 + 60_000)
        if shown:
            table = pd.DataFrame(shown, columns=["message_start", "first_ts"])
            yield table.assign(first_ts=pd.to_datetime(table["first_ts"], unit="us"))

    return rows.groupBy("message_start").applyInPandasWithState(watch, SEEN, LAST, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to parquet files and read them back."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
