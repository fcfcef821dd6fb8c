"""Checks of the site-health jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.checks.entities import AS_OF, LOG, Tables
from cohortdeck.checks.registry import check
from cohortdeck.functions import texts
from cohortdeck.functions.times import shift
from cohortdeck.operators.baselines import hourly_baselines
from cohortdeck.operators.filters import lagged_window
from cohortdeck.plans import monitoring
from cohortdeck.session import scratch_path
from cohortdeck.sources.summaries import read_summary, write_summary

SITE = "CASE WHEN left(host, 2) = 'DA' THEN 'ClearView' ELSE 'DuPont' END"
HOSTS_KEPT = " AND ".join(
    [f"host NOT LIKE '%{n}'" for n in [*range(141, 155), *range(211, 215), 500]]
    + [f"host NOT LIKE '{p}'" for p in ("DA0%", "%MIWS%", "%NEW", "DA3%", "EC3%")]
)


def site():
    return monitoring.site_of(F.col("host"))


@check(
    "counts_by_minute",
    f"""WITH {LOG} SELECT CAST(day AS VARCHAR) AS metric_date, hour(ts) AS metric_hour, minute(ts) AS metric_minute, {SITE} AS site, host, count(*) AS metric_value
    FROM log WHERE ms >= 1000 GROUP BY 1, 2, 3, 4, 5""",
)
def counts_by_minute(t: Tables) -> DataFrame:
    slow = t.log.filter(F.col("ms") >= 1000)
    return monitoring.time_bucket_counts(slow, "ts", "minute", {"site": site(), "host": F.col("host")})


@check(
    "counts_by_hour",
    f"""WITH {LOG} SELECT CAST(day AS VARCHAR) AS metric_date, hour(ts) AS metric_hour, {SITE} AS site, count(*) AS metric_value
    FROM log WHERE {HOSTS_KEPT} GROUP BY 1, 2, 3""",
)
def counts_by_hour(t: Tables) -> DataFrame:
    return monitoring.time_bucket_counts(monitoring.monitored_hosts(t.log, "host"), "ts", "hour", {"site": site()})


@check(
    "counts_above_threshold",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, hour(ts) AS metric_hour, event_type AS page, count(*) AS metric_value
    FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1, 2, 3 HAVING count(*) > 3""",
)
def counts_above_threshold(t: Tables) -> DataFrame:
    rows = t.events.filter(F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    return monitoring.time_bucket_counts(rows, "ts", "hour", {"page": F.col("event_type")}, 3)


@check(
    "severity_counts",
    f"""WITH {LOG}, m AS (SELECT day, CASE WHEN k < 30 THEN 'Page render threshold (00:00:03) x' WHEN k < 60 THEN 'Page render threshold (00:00:05) y'
        ELSE 'Page render threshold (00:00:08)' END AS message FROM log)
    SELECT CAST(day AS VARCHAR) AS metric_date, CASE WHEN substring(message, 1, 32) = 'Page render threshold (00:00:03)' THEN '3 sec'
      WHEN substring(message, 1, 32) = 'Page render threshold (00:00:05)' THEN '5 sec' ELSE 'Other' END AS severity, count(*) AS metric_value FROM m GROUP BY 1, 2""",
)
def severity_counts(t: Tables) -> DataFrame:
    k = F.col("k")
    text = (
        F.when(k < 30, "Page render threshold (00:00:03) x")
        .when(k < 60, "Page render threshold (00:00:05) y")
        .otherwise("Page render threshold (00:00:08)")
    )
    return monitoring.time_bucket_counts(t.log, "ts", "date", {"severity": monitoring.severity_of(text)})


@check(
    "search_split",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN length(rtrim(CASE WHEN event_type = 'view' THEN '  ' ELSE event_type END)) > 0
      THEN 'Cached' ELSE 'Other' END AS search_mode, count(1) AS searches, sum(CASE WHEN CAST(floor(value / 20) AS INTEGER) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty_searches
    FROM events GROUP BY 1, 2""",
)
def search_split(t: Tables) -> DataFrame:
    searches = t.events.select(
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "view", "  ").otherwise(F.col("event_type")).alias("served_by"),
        F.floor(F.col("value") / 20).cast("int").alias("found"),
    )
    return monitoring.search_split(searches, "day", "served_by", "found")


@check(
    "timeout_counts",
    f"""WITH {LOG} SELECT host, event_type, count(*) AS metric_value FROM log WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 42000 MINUTE
    GROUP BY 1, 2 HAVING count(*) > 8""",
)
def timeout_counts(t: Tables) -> DataFrame:
    return monitoring.timeouts(t.log, "ts", ["host", "event_type"], AS_OF, 42000, 8)


def _top_sql(limit: str, having: str = "") -> str:
    return f"""WITH {LOG}, d AS (SELECT * FROM log WHERE message NOT LIKE 'Page signup%' AND message NOT LIKE '%k=1_' AND message <> 'Page view failed with k=5'),
      n AS (SELECT count(1) AS total FROM d)
    SELECT replace(substring(message, 6, 300), 'failed ', '') AS message, count(*) AS total, sum(CASE WHEN {SITE} = 'ClearView' THEN 1 ELSE 0 END)::BIGINT AS clearview,
      sum(CASE WHEN {SITE} = 'DuPont' THEN 1 ELSE 0 END)::BIGINT AS dupont,
      CAST((2 * count(*) * 10000 + (SELECT total FROM n)) // (2 * (SELECT total FROM n)) AS DOUBLE) / 100 AS percent
    FROM d GROUP BY 1 {having} ORDER BY 2 DESC, 1 {limit}"""


def _messages(t: Tables) -> tuple[DataFrame, object]:
    noise = texts.matches_none(F.col("message"), ["Page signup%", "%k=1_"], ["Page view failed with k=5"])
    return t.log.filter(noise), texts.without(texts.slice_text(F.col("message"), 6, 300), "failed ")


@check("top_messages", _top_sql("LIMIT 50"))
def top_messages(t: Tables) -> DataFrame:
    rows, text = _messages(t)
    return monitoring.top_messages(rows, text, site(), n=50)


@check("frequent_messages", _top_sql("", "HAVING count(*) > 20"))
def frequent_messages(t: Tables) -> DataFrame:
    rows, text = _messages(t)
    return monitoring.top_messages(rows, text, site(), min_count=20)


@check(
    "new_messages",
    f"""WITH {LOG}, n AS (SELECT message || ' by ' || CAST(user_id // 10 AS VARCHAR) AS message, ts, host FROM log),
      prior AS (SELECT substring(message, 1, 199) AS start FROM n WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR AND ts < TIMESTAMP '2024-01-31' - INTERVAL 9000 MINUTE)
    SELECT message, count(*) AS total, CASE WHEN {SITE} = 'ClearView' THEN count(*) ELSE 0 END AS clearview, CASE WHEN {SITE} = 'DuPont' THEN count(*) ELSE 0 END AS dupont
    FROM n WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 9000 MINUTE AND substring(message, 1, 199) NOT IN (SELECT start FROM prior)
    GROUP BY message, {SITE} HAVING count(*) > 1""",
)
def new_messages(t: Tables) -> DataFrame:
    tens = F.floor(F.col("user_id") / 10).cast("string")
    rows = t.log.withColumn("message", F.concat("message", F.lit(" by "), tens))
    return monitoring.new_messages(rows, "ts", "message", site(), AS_OF, 9000, 720, 1)


@check(
    "robust_outliers",
    f"""WITH {LOG}, p AS (SELECT {SITE} AS site, host, count(1) AS cnt FROM log WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 43200 MINUTE
        AND ts < TIMESTAMP '2024-01-31' - INTERVAL 45 MINUTE GROUP BY 1, 2),
      r AS (SELECT site, cnt, row_number() OVER (PARTITION BY site ORDER BY cnt) AS up, row_number() OVER (PARTITION BY site ORDER BY cnt DESC) AS down, count(*) OVER (PARTITION BY site) AS n FROM p),
      s AS (SELECT site, stddev_samp(cnt) AS dev, (max(CASE WHEN up <= (n + 1) // 2 THEN cnt END) + min(CASE WHEN down <= (n + 1) // 2 THEN cnt END)) // 2 AS mid FROM r GROUP BY 1)
    SELECT p.site, p.host, p.cnt AS executions, mid AS median, CAST(round(dev, 0) AS BIGINT) AS deviation, CAST(round(dev, 0) AS BIGINT) AS allowed_variance, mid - p.cnt AS actual_variance,
      CAST(round(CAST(mid - p.cnt AS DOUBLE) * 100 / round(dev, 0) - 100, 0) AS DOUBLE) / 100 AS miss_ratio
    FROM p JOIN s ON s.site = p.site WHERE (mid - p.cnt) / round(dev, 0) - 1 >= 0.25 AND mid - p.cnt > dev""",
)
def robust_outliers(t: Tables) -> DataFrame:
    window = lagged_window(t.log, "ts", AS_OF, 43200, 45)
    return monitoring.low_performing(window, {"site": site()}, "host", deviations=1)


DAILY = """daily AS (SELECT CAST(l_shipdate AS DATE) AS trace_date, l_returnflag AS category, l_suppkey AS item, l_linestatus AS platform,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS executions FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2, 3, 4)"""
HOT = """hot AS (SELECT t.category, t.item, t.platform, t.executions, a.average_executions, a.total, a.n FROM daily t LEFT JOIN (
    SELECT category, item, platform, sum(executions)::BIGINT // count(DISTINCT trace_date) AS average_executions, sum(executions)::BIGINT AS total, count(DISTINCT trace_date) AS n
    FROM daily WHERE trace_date < DATE '2001-07-31' GROUP BY 1, 2, 3) a ON a.category = t.category AND a.item = t.item AND a.platform = t.platform
  WHERE t.trace_date = DATE '2001-08-01' AND t.executions > 5
    AND (coalesce(average_executions, 0) = 0 OR abs(t.executions - coalesce(average_executions, 0)) // average_executions > 0.20))"""


def _daily(t: Tables) -> DataFrame:
    keys = {"category": F.col("l_returnflag"), "item": F.col("l_suppkey"), "platform": F.col("l_linestatus")}
    return monitoring.daily_totals(t.lineitem, "l_shipdate", keys, F.col("l_quantity").cast("bigint"), "1995-01-01")


@check(
    "hot_items",
    f"""WITH {DAILY}, {HOT} SELECT category, item, platform, executions, average_executions, CAST((2 * executions + 3) // 6 AS DOUBLE) / 100 AS per_second,
      CAST((2 * ((2 * total + 3) // 6) + n) // (2 * n) AS DOUBLE) / 100 AS average_per_second, executions // average_executions AS factor FROM hot""",
)
def hot_items(t: Tables) -> DataFrame:
    return monitoring.hot_items(_daily(t), ["category", "item", "platform"], "2001-08-01", 5)


@check(
    "hot_items_decimal",
    f"""WITH {DAILY}, {HOT.replace("abs(t.executions - coalesce(average_executions, 0)) // average_executions", "abs(t.executions - average_executions) / CAST(average_executions AS DOUBLE)")}
    SELECT category, item, platform, executions, average_executions, executions // average_executions AS factor FROM hot""",
)
def hot_items_decimal(t: Tables) -> DataFrame:
    flagged = monitoring.hot_items(_daily(t), ["category", "item", "platform"], "2001-08-01", 5, decimal_ratio=True)
    return flagged.drop("per_second", "average_per_second")


@check(
    "hot_item_history",
    f"""WITH {DAILY}, {HOT} SELECT CAST(d.trace_date AS VARCHAR) AS trace_date, d.category, d.item, d.platform, sum(d.executions)::BIGINT AS metric_value
    FROM daily d JOIN hot h ON h.item = d.item AND h.category = d.category GROUP BY 1, 2, 3, 4""",
)
def hot_item_history(t: Tables) -> DataFrame:
    daily = _daily(t)
    flagged = monitoring.hot_items(daily, ["category", "item", "platform"], "2001-08-01", 5)
    return monitoring.hot_item_history(daily, flagged, ["category", "item"], "platform")


def _baseline_sql(ratio: str) -> str:
    return f"""WITH {LOG}, a AS (SELECT day, k, count(1) AS n FROM log WHERE ts BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-31' GROUP BY 1, 2),
      d AS (SELECT t.k FROM a t LEFT JOIN (SELECT k, sum(n)::BIGINT // count(DISTINCT day) AS avg_n FROM a WHERE day < DATE '2024-01-30' GROUP BY 1) b ON b.k = t.k
        WHERE t.day = DATE '2024-01-30' AND t.n > 2 AND (coalesce(avg_n, 0) = 0 OR {ratio} > 0.25))
    SELECT CAST(day AS VARCHAR) AS metric_date, k::BIGINT AS k, n AS metric_value FROM a JOIN d USING (k)"""


@check("above_baseline", _baseline_sql("abs(t.n - avg_n) // avg_n"))
def above_baseline(t: Tables) -> DataFrame:
    return monitoring.above_baseline(t.log, "ts", "k", AS_OF, 30, 2)


@check("above_baseline_decimal", _baseline_sql("abs(t.n - avg_n) / CAST(avg_n AS DOUBLE)"))
def above_baseline_decimal(t: Tables) -> DataFrame:
    return monitoring.above_baseline(t.log, "ts", "k", AS_OF, 30, 2, decimal_ratio=True)


TIERED = """WITH h AS (SELECT date_trunc('hour', ts) AS hr, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    b AS (SELECT h.hr, h.event_type, h.n, coalesce(p.n, 0) AS prev, coalesce(y.n, 0) AS yest, coalesce((SELECT sum(w.n)::BIGINT // count(*) FROM h w
        WHERE w.event_type = h.event_type AND w.hr IN (h.hr - INTERVAL 7 DAY, h.hr - INTERVAL 14 DAY, h.hr - INTERVAL 21 DAY, h.hr - INTERVAL 28 DAY)), 0) AS week
      FROM h LEFT JOIN h p ON p.event_type = h.event_type AND p.hr = h.hr - INTERVAL 1 HOUR LEFT JOIN h y ON y.event_type = h.event_type AND y.hr = h.hr - INTERVAL 1 DAY)
  SELECT event_type, strftime(hr, '%Y-%m-%d %H:%M:%S') AS hour_start, n AS executions, prev AS previous_hour, yest AS yesterday, week AS weekly_average FROM b
  WHERE ((week = 0 AND yest = 0 AND prev = 0 AND n > 3) OR (week > 0 AND n > 2 * week) OR (week = 0 AND prev > 0 AND n > 2 * prev)
    OR (week = 0 AND prev = 0 AND yest > 0 AND n > 2 * yest) OR n > 8) AND n > 2"""


@check("hourly_tiered_alert", TIERED)
def hourly_tiered_alert(t: Tables) -> DataFrame:
    return monitoring.hourly_alerts(t.events, "ts", ["event_type"], new_page=3, catch_all=8, noise=2)


@check("incremental_hourly", TIERED)
def incremental_hourly(t: Tables) -> DataFrame:
    """The same from stored hours: three batches, of which one brings late rows, and one that is sent twice."""
    store = monitoring.hourly_store(t.spark, scratch_path(t.spark, "hours"), {"event_type": "string"})
    late = (F.col("event_id") % 3 == 0) & (F.col("ts") < "2024-01-15")
    first, last = F.col("ts") < "2024-01-15", F.col("ts") >= "2024-01-22 07:30:00"
    batches = [(1, first & ~late), (2, ~first & ~last), (3, last | late), (2, ~first & ~last)]
    for number, rows in batches:
        monitoring.add_hours(store, t.events.filter(rows), "ts", number)
    store.compact()
    return monitoring.stored_alerts(store, new_page=3, catch_all=8, noise=2)


@check(
    "hourly_summary_alerts",
    """WITH h AS (SELECT date_trunc('hour', ts) AS hr, user_id AS page, count(*) AS n FROM events GROUP BY 1, 2),
      b AS (SELECT h.hr, h.page, h.n, coalesce(p.n, 0) AS prev, coalesce(y.n, 0) AS yest, coalesce((SELECT sum(w.n)::BIGINT // count(*) FROM h w
          WHERE w.page = h.page AND w.hr IN (h.hr - INTERVAL 7 DAY, h.hr - INTERVAL 14 DAY, h.hr - INTERVAL 21 DAY, h.hr - INTERVAL 28 DAY)), 0) AS week
        FROM h LEFT JOIN h p ON p.page = h.page AND p.hr = h.hr - INTERVAL 1 HOUR LEFT JOIN h y ON y.page = h.page AND y.hr = h.hr - INTERVAL 1 DAY)
    SELECT CAST(CAST(hr AS DATE) AS VARCHAR) AS log_date, hour(hr) AS log_hour, c_name AS page_name, n AS executions, prev AS previous_hour, week AS weekly_average, yest AS yesterday
    FROM b JOIN customer ON c_custkey = page WHERE hr = TIMESTAMP '2024-01-29 10:00:00' AND n > 0
      AND ((week = 0 AND yest = 0 AND prev = 0 AND n > 0) OR (week > 0 AND n > 2 * week) OR (week = 0 AND prev > 0 AND n > 2 * prev)
      OR (week = 0 AND prev = 0 AND yest > 0 AND n > 2 * yest) OR n > 8)""",
)
def hourly_summary_alerts(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("page"), "ts")
    base = hourly_baselines(log, "ts", ["page"])
    path = scratch_path(t.spark, "hourly-summary")
    write_summary(base, path, base.schema)
    stored = read_summary(t.spark, path, base.schema)
    pages = t.customer.select(F.col("c_custkey").alias("page"), F.col("c_name").alias("page_name"))
    return monitoring.summary_alerts(
        stored, pages, "page", "page_name", "2024-01-29 11:20:00", new_page=0, catch_all=8, noise=0
    )


@check(
    "message_trend",
    f"""WITH {LOG} SELECT CAST(day AS VARCHAR) AS metric_date, count(*) AS metric_value FROM log WHERE message LIKE 'Page click%' AND ts >= TIMESTAMP '2024-01-02' GROUP BY 1""",
)
def message_trend(t: Tables) -> DataFrame:
    return monitoring.message_trend(t.log, "ts", "message", "Page click", "2024-01-02")


@check(
    "slow_components",
    f"""WITH {LOG}, s AS (SELECT event_type, session_week, ms FROM (SELECT *, split_part(session_id, '-', 2) AS session_week, ms * k AS share, ms * 100 AS total FROM log)
        WHERE ms >= 2000 AND share / total >= 0.5 AND ms > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type, session_week ORDER BY ms) AS up, row_number() OVER (PARTITION BY event_type, session_week ORDER BY ms DESC) AS down,
        count(*) OVER (PARTITION BY event_type, session_week) AS n FROM s),
      g AS (SELECT event_type, session_week, count(*) AS occurrences, sum(ms)::BIGINT AS total, stddev_samp(ms) / 1000 AS dev,
        ((max(CASE WHEN up <= (n + 1) // 2 THEN ms END) + min(CASE WHEN down <= (n + 1) // 2 THEN ms END)) // 2) / 1000 AS mid FROM r GROUP BY 1, 2)
    SELECT event_type, session_week, occurrences, CAST((2 * total + occurrences) // (2 * occurrences) AS DOUBLE) / 1000 AS average_seconds FROM g
    WHERE dev IS NOT NULL AND mid > 4.0 AND occurrences - mid > dev * 2 AND occurrences > 30""",
)
def slow_components(t: Tables) -> DataFrame:
    week = F.split_part("session_id", F.lit("-"), F.lit(2))
    pages = t.log.select(
        "event_type",
        week.alias("session_week"),
        "ms",
        (F.col("ms") * F.col("k")).cast("double").alias("share"),
        (F.col("ms") * 100).cast("double").alias("total"),
    ).filter(F.col("ms") >= 2000)
    return monitoring.slow_components(
        pages, ["event_type", "session_week"], "total", "share", "ms", slow_ms=0, min_share=0.5, min_count=30
    )


@check(
    "slow_servers",
    f"""WITH {LOG}, p AS (SELECT {SITE} AS site, host, count(1) AS cnt FROM log WHERE ms >= 3000 AND k / 100.0 < 0.9 GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cnt) AS up, row_number() OVER (PARTITION BY site ORDER BY cnt DESC) AS down, count(*) OVER (PARTITION BY site) AS n FROM p),
      s AS (SELECT site, stddev_samp(cnt) AS dev, sum(cnt)::BIGINT // count(*) AS avg_n, (max(CASE WHEN up <= (n + 1) // 2 THEN cnt END) + min(CASE WHEN down <= (n + 1) // 2 THEN cnt END)) // 2 AS mid FROM r GROUP BY 1)
    SELECT p.site, p.host, p.cnt AS slow_pages, avg_n AS average, mid AS median, CAST(floor(dev) AS BIGINT) AS deviation FROM p JOIN s ON s.site = p.site
    WHERE p.cnt - mid > dev * 2 AND p.cnt > avg_n * 1.5 AND p.cnt > 5 AND floor(dev) > 0""",
)
def slow_servers(t: Tables) -> DataFrame:
    slow = t.log.filter((F.col("ms") >= 3000) & (F.col("k") / 100 < 0.9))
    return monitoring.slow_servers(slow, {"site": site()}, "host", 5)


@check(
    "slow_sources",
    f"""WITH {LOG}, a AS (SELECT host, event_type AS source, count(1) AS total, sum(CASE WHEN {SITE} = 'ClearView' THEN 1 ELSE 0 END)::BIGINT AS clearview,
        sum(CASE WHEN {SITE} = 'DuPont' THEN 1 ELSE 0 END)::BIGINT AS dupont, sum(ms)::BIGINT // count(*) AS total_time, sum(ms * k // 100)::BIGINT // count(*) AS share_time FROM log WHERE ms >= 500 GROUP BY 1, 2),
      b AS (SELECT *, CAST((2 * share_time * 1000000 + total_time) // (2 * total_time) AS BIGINT) AS millionths FROM a)
    SELECT source, sum(total)::BIGINT AS total, sum(clearview)::BIGINT AS clearview, sum(dupont)::BIGINT AS dupont, sum(total_time)::BIGINT AS total_time, sum(share_time)::BIGINT AS share_time,
      CAST((2 * sum(millionths)::BIGINT + count(*) * 100) // (2 * count(*) * 100) AS DOUBLE) / 10000 AS ratio
    FROM b WHERE millionths > 500000 GROUP BY 1 HAVING sum(total) > 100""",
)
def slow_sources(t: Tables) -> DataFrame:
    pages = t.log.filter(F.col("ms") >= 500).select(
        "host", F.col("event_type").alias("source"), "ms", F.floor(F.col("ms") * F.col("k") / 100).cast("bigint").alias("share")
    )
    return monitoring.slow_sources(pages, "host", "source", "ms", "share", site(), min_count=100)


ALIASES = ("x1mass02", "MASESS", "DAL16", "q_masr7", "MAREGWRITE", "MASchEng", "Chint", "other")
PAGES = """pages AS (SELECT event_id AS seq, ts, substring(site_code, 1, 2) || '1MAWS' || lpad(CAST(user_id % 230 AS VARCHAR), 3, '0') AS host,
    ms * 3 AS total_ms, ms * 3 * (k % 3) // 2 AS db_ms FROM log),
  calls AS (SELECT event_id AS seq, ts + (k - 20) * INTERVAL 1 MINUTE AS ts, k % 25 AS procedure_id, user_id % 40 AS alias_id, ms - 300 AS component_ms FROM log
    UNION ALL SELECT event_id, ts, k % 30, user_id % 8, ms FROM log WHERE k % 2 = 0),
  procedures AS (SELECT n_nationkey AS procedure_id, n_name AS procedure FROM nation),
  aliases AS (SELECT s_suppkey AS alias_id, list_extract(['x1mass02', 'MASESS', 'DAL16', 'q_masr7', 'MAREGWRITE', 'MASchEng', 'Chint', 'other'], CAST(s_suppkey % 8 + 1 AS INTEGER)) AS source FROM supplier)"""
NOT_WATCHED = f"({HOSTS_KEPT}) AND host <> 'DA1MAWS057'"


def _page_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Headers, calls and names of a page log, from the site's log and two dimension tables."""
    log, user, k, ms = t.log, F.col("user_id"), F.col("k"), F.col("ms")
    host = F.concat(F.substring("site_code", 1, 2), F.lit("1MAWS"), F.lpad((user % 230).cast("string"), 3, "0"))
    seq = F.col("event_id").alias("seq")
    headers = log.select(seq, "ts", host.alias("host"), (ms * 3).alias("total_ms"), F.expr("ms * 3 * (k % 3) div 2").alias("db_ms"))
    first = log.select(
        seq, shift(F.col("ts"), k - 20, "MINUTE").alias("ts"), (k % 25).alias("procedure_id"), (user % 40).alias("alias_id"), (ms - 300).alias("component_ms")
    )
    second = log.filter(k % 2 == 0).select(seq, "ts", (k % 30).alias("procedure_id"), (user % 8).alias("alias_id"), ms.alias("component_ms"))
    procedures = t.nation.select(F.col("n_nationkey").alias("procedure_id"), F.col("n_name").alias("procedure"))
    alias = F.element_at(F.array(*map(F.lit, ALIASES)), (F.col("s_suppkey") % 8 + 1).cast("int"))
    return headers, first.unionByName(second), procedures, t.supplier.select(F.col("s_suppkey").alias("alias_id"), alias.alias("source"))


@check(
    "slow_components_whole",
    f"""WITH {LOG}, {PAGES}, s AS (SELECT CASE WHEN left(host, 2) = 'DA' THEN 'ClearView' ELSE 'DuPont' END AS site, source, component_ms AS ms
        FROM pages p JOIN calls c ON c.seq = p.seq JOIN procedures USING (procedure_id) JOIN aliases USING (alias_id)
        WHERE p.ts >= TIMESTAMP '2024-01-10 00:00:00' AND c.ts >= TIMESTAMP '2024-01-10 00:00:00' AND component_ms > 0 AND total_ms >= 2000
          AND db_ms // total_ms >= 0.75 AND {NOT_WATCHED}),
      r AS (SELECT *, row_number() OVER (PARTITION BY site, source ORDER BY ms) AS up, row_number() OVER (PARTITION BY site, source ORDER BY ms DESC) AS down,
        count(*) OVER (PARTITION BY site, source) AS n FROM s),
      g AS (SELECT site, source, count(*) AS occurrences, sum(ms)::BIGINT AS total, stddev_samp(ms) / 1000 AS dev,
        ((max(CASE WHEN up <= (n + 1) // 2 THEN ms END) + min(CASE WHEN down <= (n + 1) // 2 THEN ms END)) // 2) / 1000 AS mid FROM r GROUP BY 1, 2)
    SELECT site, source, occurrences, CAST((2 * total + occurrences) // (2 * occurrences) AS DOUBLE) / 1000 AS average_seconds FROM g
    WHERE dev IS NOT NULL AND mid > 1.0 AND occurrences - mid > dev * 2 AND occurrences > 20""",
)
def slow_components_whole(t: Tables) -> DataFrame:
    """From headers and calls to the sources that slow pages wait for; shares of whole numbers."""
    pages = monitoring.slow_page_details(*_page_tables(t), as_of=AS_OF, minutes=21 * 24 * 60, slow_ms=2000)
    return monitoring.slow_components(
        pages, ["site", "source"], "total_ms", "db_ms", "component_ms", slow_ms=2000, min_share=0.75, min_seconds=1.0, min_count=20
    )


@check(
    "classify_sources",
    f"""WITH {LOG}, {PAGES}, s AS (SELECT source, total_ms, db_ms FROM pages p LEFT JOIN calls c ON c.seq = p.seq LEFT JOIN procedures USING (procedure_id)
        LEFT JOIN aliases USING (alias_id) WHERE p.ts >= TIMESTAMP '2024-01-30 12:00:00' AND total_ms >= 5000 AND {NOT_WATCHED})
    SELECT CASE WHEN source ILIKE '%mass%' OR source ILIKE 'MASESS' THEN 'Session' WHEN source ILIKE 'DAL16' OR source ILIKE '%masr%' THEN 'Read'
        WHEN source ILIKE 'MAREGWRITE' THEN 'Reg' WHEN source ILIKE 'MASchEng' THEN 'Search Engine' WHEN source ILIKE 'CHINT' THEN 'Chem Int' ELSE source END AS class,
      count(*) AS calls, sum(total_ms)::BIGINT AS total_ms, sum(db_ms)::BIGINT AS db_ms FROM s GROUP BY 1""",
)
def classify_sources(t: Tables) -> DataFrame:
    """Slow pages of the last half day by the class of the sources they called, also pages without a call."""
    pages = monitoring.slow_page_details(*_page_tables(t), as_of=AS_OF, minutes=12 * 60, slow_ms=5000, keep_without_details=True)
    return pages.groupBy(monitoring.source_class(F.col("source")).alias("class")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_ms").alias("total_ms"), F.sum("db_ms").alias("db_ms")
    )
