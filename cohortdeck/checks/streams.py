"""Checks of the streaming monitors: run over the whole log, compared with batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.checks.entities import Tables
from cohortdeck.checks.registry import check
from cohortdeck.checks.monitoring_jobs import TIERED
from cohortdeck.operators.filters import between_moments
from cohortdeck.plans.monitoring import hourly_store
from cohortdeck.session import scratch_path
from cohortdeck.streaming import monitors

CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


CUTS = ("2024-01-09", "2024-01-17 06:00:00", "2024-01-24 12:30:00")


def _arriving(t: Tables, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Let the log arrive slice after slice and run the stream on each, so that state crosses batches and restarts."""
    folder = scratch_path(t.spark, "arriving")
    for start, end in zip((None, *CUTS), (*CUTS, None)):
        between_moments(t.events, "ts", start, end).write.mode("append").parquet(folder)
        result = run(monitors.file_stream(t.spark, folder, t.events.schema))
    return result


def _run(t: Tables, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    out, state = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-state")
    return _arriving(t, lambda log: monitors.run_to_files(build(log), out, state))


def _with_message(log: DataFrame) -> DataFrame:
    return log.withColumn("message", F.concat("event_type", F.lit("#"), "props"))


@check(
    "minute_counts_stream",
    f"""SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS metric_value FROM events
    GROUP BY date_trunc('minute', ts), event_type HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED}""",
)
def minute_counts_stream(t: Tables) -> DataFrame:
    return _run(t, lambda log: monitors.bucket_counts(log, "ts", ["event_type"]), "minute-counts")


@check(
    "rolling_alert_stream",
    f"""WITH w AS (SELECT event_type, date_trunc('hour', ts) - s * INTERVAL 1 HOUR AS start FROM events, (SELECT unnest(range(0, 4)) AS s))
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS metric_value FROM w
    GROUP BY start, event_type HAVING count(*) > 14 AND start + INTERVAL 4 HOUR <= {CLOSED}""",
)
def rolling_alert_stream(t: Tables) -> DataFrame:
    return _run(t, lambda log: monitors.rolling_alerts(log, "ts", ["event_type"], 14, "4 hours", "1 hour"), "rolling")


@check(
    "new_message_stream",
    "SELECT DISTINCT substring(event_type || '#' || props, 1, 199) AS message_start FROM events",
)
def new_message_stream(t: Tables) -> DataFrame:
    first = _run(t, lambda log: monitors.first_seen_messages(_with_message(log), "ts", "message", "40 days"), "first-seen")
    return first.select("message_start")


BURSTS = """WITH m AS (SELECT event_type || '#' || props AS message_start, ts FROM events),
      g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY message_start ORDER BY ts) + INTERVAL 30 HOUR THEN 0 ELSE 1 END AS opens FROM m),
      n AS (SELECT *, sum(opens) OVER (PARTITION BY message_start ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT message_start, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS total
    FROM n GROUP BY message_start, burst"""


@check("message_bursts", BURSTS)
def message_bursts(t: Tables) -> DataFrame:
    return monitors.message_bursts(_with_message(t.events), "ts", "message", "30 hours")


@check("message_bursts_stream", f"{BURSTS} HAVING max(ts) + INTERVAL 30 HOUR <= {CLOSED}")
def message_bursts_stream(t: Tables) -> DataFrame:
    """Bursts that are over, handed out by the stream."""
    return _run(t, lambda log: monitors.message_bursts(_with_message(log), "ts", "message", "30 hours"), "bursts")


@check("tiered_alert_stream", f"{TIERED} AND hr + INTERVAL 1 HOUR <= {CLOSED}")
def tiered_alert_stream(t: Tables) -> DataFrame:
    """The batch rule on a stream, against stored hours."""
    store = hourly_store(t.spark, scratch_path(t.spark, "stream-hours"), {"event_type": "string"})
    out, state = scratch_path(t.spark, "tiered"), scratch_path(t.spark, "tiered-state")
    limits = {"new_page": 3, "catch_all": 8, "noise": 2}
    return _arriving(t, lambda log: monitors.run_tiered_alerts(log, "ts", store, out, state, **limits))


@check(
    "unseen_stream",
    f"""WITH m AS (SELECT event_type || '#' || props AS message_start, ts FROM events),
      g AS (SELECT *, lag(ts) OVER (PARTITION BY message_start ORDER BY ts) AS before FROM m)
    SELECT message_start, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_ts FROM g
    WHERE (before IS NULL OR ts >= before + INTERVAL 30 HOUR) AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED}""",
)
def unseen_stream(t: Tables) -> DataFrame:
    """Messages unseen for 30 hours, told when their minute is over; the log is 30 days long."""
    minutes, minute_state, out, state = [scratch_path(t.spark, f"unseen-{k}") for k in ("minutes", "minute-state", "out", "state")]

    def run(log: DataFrame) -> DataFrame:
        stored = monitors.run_to_files(monitors.message_minutes(_with_message(log), "ts", "message"), minutes, minute_state)
        arriving = monitors.file_stream(t.spark, minutes, stored.schema)
        return monitors.run_to_files(monitors.unseen_messages(arriving, "30 hours"), out, state)

    return _arriving(t, run)
