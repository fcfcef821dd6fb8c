"""Site health: counts over time, messages, baselines, outliers, tiered alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.labels import first_match
from cohortdeck.functions.numbers import int_div
from cohortdeck.functions.texts import head, matches_none, slice_text, starts_with_param, tail, text_length
from cohortdeck.functions.times import Moment, midnight, moment, shift, shift_days
from cohortdeck.operators.aggregates import count_when, percent_of_total, top_rows
from cohortdeck.operators.baselines import (
    baseline_lags,
    baselines_of,
    day_against_average,
    group_spread,
    high_outliers,
    hourly_baselines,
    low_outliers,
    tiered_alert,
    touched_hours,
)
from cohortdeck.operators.filters import between_moments, rolling_window
from cohortdeck.operators.joins import not_in, null_safe_join
from cohortdeck.sources.published import Increments, Published

TIME_PARTS = {
    "date": lambda ts: F.to_date(ts).alias("metric_date"),
    "hour": lambda ts: F.hour(ts).alias("metric_hour"),
    "minute": lambda ts: F.minute(ts).alias("metric_minute"),
}
GRAINS = {"date": ("date",), "hour": ("date", "hour"), "minute": ("date", "hour", "minute")}


def site_of(host: Column, prefix: str = fixed.SITE_PREFIX, labels: tuple[str, str] = fixed.SITE_LABELS) -> Column:
    """Data centre of a host by its name's first letters."""
    return F.when(host.startswith(prefix), labels[0]).otherwise(labels[1])


def platform_of(host: Column, default: str = "Main") -> Column:
    """Platform of a host by its last three digits."""
    last = tail(host, 3)
    return first_match(
        [(last.isin(*fixed.MOBILE_HOSTS), "Mobile"), (last.isin(*fixed.THIRD_HOSTS), "G3")], default
    )


def monitored_hosts(log: DataFrame, host: str, patterns: Sequence[str] = fixed.EXCLUDED_HOSTS, names: Sequence[str] = ()) -> DataFrame:
    """Rows of hosts that are not excluded; rows without a host are out."""
    return log.filter(matches_none(F.col(host), patterns, names))


def severity_of(message: Column) -> Column:
    """Severity band of a slow-page message by its first 32 characters."""
    return first_match(
        [(head(message, 32) == text, label) for text, label in fixed.SEVERITY_PREFIXES.items()], "Other"
    )


def time_bucket_counts(
    log: DataFrame,
    ts: str,
    grain: str = "hour",
    keys: Mapping[str, Column] | None = None,
    min_count: int | None = None,
    name: str = "metric_value",
) -> DataFrame:
    """Row counts by date, hour or minute and further keys, above ``min_count`` if given."""
    keys = keys or {}
    parts = [TIME_PARTS[part](ts) for part in GRAINS[grain]]
    counts = log.groupBy(*parts, *[column.alias(k) for k, column in keys.items()]).agg(
        F.count(F.lit(1)).alias(name)
    )
    if min_count is not None:
        counts = counts.filter(F.col(name) > min_count)
    return counts.orderBy(*[f"metric_{part}" for part in GRAINS[grain]], *keys)


def search_split(searches: DataFrame, day: str, host: str, rows: str) -> DataFrame:
    """Searches and empty searches per day, by whether a cache host served them."""
    mode = F.when(text_length(F.col(host)) > 0, "Cached").otherwise("Other")
    return searches.groupBy(day, mode.alias("search_mode")).agg(
        F.count(F.lit(1)).alias("searches"), count_when(F.col(rows) == 0).alias("empty_searches")
    ).orderBy(day, "search_mode")


def top_messages(
    log: DataFrame,
    message: str | Column,
    site: Column,
    n: int | None = None,
    min_count: int | None = None,
    sites: tuple[str, str] = fixed.SITE_LABELS,
) -> DataFrame:
    """Messages with count, percent of all counted rows and a split by site.

    The percentage is of all rows of ``log``, also of those under ``min_count``.
    """
    text = F.col(message) if isinstance(message, str) else message
    counts = log.groupBy(text.alias("message")).agg(
        F.count(F.lit(1)).alias("total"),
        *[count_when(site == label).alias(label.lower()) for label in sites],
    )
    shares = percent_of_total(counts, "total", "percent")
    if min_count is not None:
        shares = shares.filter(F.col("total") > min_count)
    if n is not None:
        return top_rows(shares, n, "total", ["message"])
    return shares.orderBy(F.col("total").desc(), "message")


def new_messages(
    log: DataFrame,
    ts: str,
    message: str,
    site: Column,
    as_of: Moment,
    recent_minutes: int = 60,
    prior_hours: int = 6,
    min_count: int = 10,
    prefix: tuple[int, int] = fixed.MESSAGE_PREFIX,
    sites: tuple[str, str] = fixed.SITE_LABELS,
) -> DataFrame:
    """Recent messages whose beginning did not occur in the hours before.

    The prior window ends where the recent one starts.  A null prior message means
    nothing is new, as NOT IN has it.  Both sides shrink to distinct texts before
    they meet.  One row per site and message.
    """
    recent_start = shift(as_of, -recent_minutes, "MINUTE")
    recent = between_moments(log, ts, recent_start, None)
    prior = between_moments(log, ts, shift(as_of, -prior_hours, "HOUR"), recent_start)
    counts = recent.groupBy(site.alias("_site"), F.col(message).alias("message")).agg(
        F.count(F.lit(1)).alias("total")
    )
    started = counts.withColumn("_start", slice_text(F.col("message"), *prefix))
    known = prior.select(slice_text(F.col(message), *prefix).alias("_known")).distinct()
    fresh = not_in(started, "_start", known, "_known").filter(F.col("total") > min_count)
    split = [F.when(F.col("_site") == label, F.col("total")).otherwise(0).alias(label.lower()) for label in sites]
    return fresh.select("message", "total", *split).orderBy("total", "message")


def low_performing(
    log: DataFrame, group: Mapping[str, Column], host: str, deviations: int = 2, miss: float = 0.25
) -> DataFrame:
    """Hosts with far fewer rows than the median host of their group."""
    keys = list(group)
    counts = log.groupBy(*[c.alias(k) for k, c in group.items()], host).agg(F.count(F.lit(1)).alias("executions"))
    found = low_outliers(counts, keys, "executions", deviations, miss, cells=1)
    return found.select(
        *keys,
        host,
        "executions",
        F.col("median").cast("decimal(20,0)").cast("bigint").alias("median"),
        F.col("deviation").cast("decimal(20,0)").cast("bigint").alias("deviation"),
        F.col("allowed_variance").cast("bigint").alias("allowed_variance"),
        "actual_variance",
        "miss_ratio",
    ).orderBy(F.col("executions").desc(), host)


def daily_totals(log: DataFrame, ts: str, keys: Mapping[str, Column], measure: Column, start: Moment) -> DataFrame:
    """Daily sums per key since ``start``."""
    return between_moments(log, ts, midnight(start), None).groupBy(
        F.to_date(ts).alias("trace_date"), *[c.alias(k) for k, c in keys.items()]
    ).agg(F.sum(measure).alias("executions"))


def hot_items(
    daily: DataFrame,
    keys: Sequence[str],
    today: Moment,
    min_count: int = 1000,
    factor: float = 0.20,
    decimal_ratio: bool = False,
    seconds: int = fixed.TRACE_SECONDS,
) -> DataFrame:
    """Items far busier or quieter today than on an average earlier day.

    ``daily`` comes from ``daily_totals``.  Yesterday is left out of the average.
    Rates are per second of the traced ``seconds``; the earlier rate is divided by
    the number of days after rounding.
    """
    flagged = day_against_average(
        daily, keys, "trace_date", "executions", today, shift_days(today, -1), min_count, factor, decimal_ratio
    )
    now = F.col("on_day")

    def per_second(total: Column) -> Column:
        return F.round(total.cast("decimal(20,0)") / seconds, 2).cast("decimal(18,2)")

    return flagged.select(
        *keys,
        now.alias("executions"),
        F.col("average").alias("average_executions"),
        per_second(now).alias("per_second"),
        F.try_divide(per_second(F.col("earlier_total")), F.col("earlier_days")).cast("decimal(28,2)").alias(
            "average_per_second"
        ),
        int_div(now, F.col("average")).alias("factor"),
    ).orderBy(F.col("factor").desc(), *keys)


def hot_item_history(daily: DataFrame, flagged: DataFrame, item: Sequence[str], by: str) -> DataFrame:
    """Daily totals of flagged items per ``by``.

    An item flagged under several values of ``by`` is multiplied by their number,
    as joining on the item alone does.
    """
    times = flagged.groupBy(*item).agg(F.count(F.lit(1)).alias("_times"))
    return (
        null_safe_join(daily, times, item)
        .groupBy("trace_date", *item, by)
        .agg(F.sum(F.col("executions") * F.col("_times")).alias("metric_value"))
        .orderBy("trace_date", *item, by)
    )


def above_baseline(
    log: DataFrame,
    ts: str,
    key: str,
    as_of: Moment,
    days: int = 10,
    min_count: int = 10000,
    factor: float = 0.25,
    decimal_ratio: bool = False,
) -> DataFrame:
    """Daily trend of the keys whose yesterday is far from their average before.

    The window is the ``days`` before ``as_of`` up to its midnight, both included.
    """
    start = midnight(shift_days(as_of, -days))
    window = log.filter((F.col(ts) >= start) & (F.col(ts) <= midnight(as_of)))
    daily = window.groupBy(F.to_date(ts).alias("metric_date"), key).agg(F.count(F.lit(1)).alias("metric_value"))
    yesterday = shift_days(as_of, -1)
    flagged = day_against_average(
        daily, [key], "metric_date", "metric_value", yesterday, yesterday, min_count, factor, decimal_ratio
    )
    return null_safe_join(daily, flagged.select(key), [key], "left_semi").orderBy("metric_date", key)


def hourly_alerts(
    log: DataFrame, ts: str, keys: Sequence[str], hour: Moment | None = None, **thresholds: int
) -> DataFrame:
    """Hours (or one hour) whose count breaks the tiered rule, with their baselines.

    For one hour only the hours it is compared with are read.
    """
    if hour is not None:
        lags = (0, 1, 24, 24 * 7, 24 * 14, 24 * 21, 24 * 28)
        needed = [
            (F.col(ts) >= shift(hour, -lag, "HOUR")) & (F.col(ts) < shift(hour, 1 - lag, "HOUR")) for lag in lags
        ]
        log = between_moments(log, ts, shift(hour, -lags[-1], "HOUR"), shift(hour, 1, "HOUR")).filter(
            _any(needed)
        )
    base = hourly_baselines(log, ts, keys)
    if hour is not None:
        base = base.filter(F.col("hour_start") == moment(hour))
    rule = tiered_alert(
        F.col("executions"), F.col("weekly_average"), F.col("previous_hour"), F.col("yesterday"), **thresholds
    )
    return (
        base.filter(rule)
        .fillna(0, ["previous_hour", "yesterday", "weekly_average"])
        .orderBy("hour_start", *keys)
    )


def hourly_counts(log: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """``executions`` per key and ``hour_start``."""
    hourly = log.groupBy(*keys, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour")).agg(F.count(F.lit(1)).alias("executions"))
    start = shift(F.col("_day").cast("timestamp_ntz"), F.col("_hour"), "HOUR")
    return hourly.select(*keys, start.alias("hour_start"), "executions")


def hourly_store(spark: SparkSession, path: str, keys: dict[str, str]) -> Increments:
    """The stored hourly counts of a log; ``keys`` are names and types."""
    columns = [f"`{k}` {kind}" for k, kind in keys.items()]
    schema = StructType.fromDDL(", ".join([*columns, "hour_start timestamp_ntz", "executions bigint"]))
    return Increments(Published(spark, path, schema))


def add_hours(store: Increments, log: DataFrame, ts: str, batch: int) -> bool:
    """Add a batch of the log to the stored hours; late rows add to their hour, a known batch changes nothing."""
    return store.append(hourly_counts(log, ts, [k for k in store.keys if k != "hour_start"]), batch)


def stored_alerts(store: Increments, changed: DataFrame | None = None, **thresholds: int) -> DataFrame:
    """Alarming hours by the stored counts, without reading the log.

    ``changed`` (the store's keys with ``hour_start``) limits the work to hours whose count or
    baselines a change of these hours can alter: ``store.batch(n)`` gives those of a batch.
    """
    keys = [k for k in store.keys if k != "hour_start"]
    hourly, wanted = store.state(), None
    if changed is not None:
        wanted = touched_hours(changed, keys)
        first, last = changed.agg(F.min("hour_start"), F.max("hour_start")).first()
        if first is None:
            hourly = hourly.limit(0)
        else:
            span = timedelta(hours=max(lag for _, lag in baseline_lags()))
            hourly = hourly.filter(F.col("hour_start").between(F.lit(first - span), F.lit(last + span)))
    base = baselines_of(hourly, keys, wanted=wanted)
    rule = tiered_alert(F.col("executions"), F.col("weekly_average"), F.col("previous_hour"), F.col("yesterday"), **thresholds)
    return base.filter(rule).fillna(0, ["previous_hour", "yesterday", "weekly_average"])


def summary_alerts(
    summary: DataFrame, pages: DataFrame, page: str, page_name: str, as_of: Moment, **thresholds: int
) -> DataFrame:
    """Alarming pages of the hour before ``as_of``, from a stored hourly summary.

    ``summary`` has the columns of ``hourly_baselines`` with the page as key and is
    written by ``write_summary`` or day by day; only the wanted hour is read from it.
    """
    before = shift(as_of, -1, "HOUR")
    hour = shift(midnight(before), F.hour(before), "HOUR")
    rule = tiered_alert(
        F.col("executions"), F.col("weekly_average"), F.col("previous_hour"), F.col("yesterday"), **thresholds
    )
    found = summary.filter((F.col("hour_start") == hour) & rule)
    return (
        found.join(pages.select(page, page_name), [page])
        .fillna(0, ["previous_hour", "yesterday", "weekly_average"])
        .select(
            F.to_date("hour_start").alias("log_date"),
            F.hour("hour_start").alias("log_hour"),
            page_name,
            "executions",
            "previous_hour",
            "weekly_average",
            "yesterday",
        )
        .orderBy(page_name)
    )


def message_trend(
    log: DataFrame, ts: str, message: str, prefix: str, start: Moment | None = None, escape: bool = True
) -> DataFrame:
    """Daily counts of the messages beginning with ``prefix``."""
    rows = between_moments(log, ts, start, None).filter(starts_with_param(F.col(message), prefix, escape))
    return time_bucket_counts(rows, ts, "date")


def _any(tests: Sequence[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def source_class(alias: Column, rules: Sequence[tuple[str, str]] = fixed.SOURCE_CLASSES) -> Column:
    """Class of a data source by the first pattern its alias fits; else the alias itself, null for none."""
    name = F.lower(alias)

    def fits(pattern: str) -> Column:
        text = pattern.strip("%").lower()
        return name.contains(text) if pattern.startswith("%") else name == text

    return first_match([(fits(pattern), label) for pattern, label in rules], alias)


def slow_page_details(
    headers: DataFrame,
    details: DataFrame,
    procedures: DataFrame,
    aliases: DataFrame,
    as_of: Moment,
    minutes: int = 60,
    slow_ms: int = fixed.SLOW_MS,
    patterns: Sequence[str] = fixed.EXCLUDED_HOSTS,
    names: Sequence[str] = fixed.EXCLUDED_HOST_NAMES,
    keep_without_details: bool = False,
) -> DataFrame:
    """The calls of recent slow pages with their names: the input of ``slow_components`` and ``slow_sources``.

    ``headers``: seq, ts, host, total_ms, db_ms.  ``details``: seq, ts, procedure_id, alias_id,
    component_ms.  ``procedures``: procedure_id, procedure.  ``aliases``: alias_id, source.
    Both logs are read from ``minutes`` before ``as_of`` on, and pages and calls are filtered
    before they meet, so what moves is the slow part of the last minutes.  By default only calls
    that took time and are known by name count; ``keep_without_details`` keeps every slow page,
    with nulls, and every call.
    """
    start = shift(as_of, -minutes, "MINUTE")
    slow = between_moments(headers, "ts", start, None).filter(F.col("total_ms") >= slow_ms)
    pages = monitored_hosts(slow, "host", patterns, names).select("seq", "host", "total_ms", "db_ms")
    calls = details.select("seq", "ts", "procedure_id", "alias_id", "component_ms")
    how = "left"
    if not keep_without_details:
        calls, how = between_moments(calls, "ts", start, None).filter(F.col("component_ms") > 0), "inner"
    return (
        pages.join(calls.drop("ts"), ["seq"], how)
        .join(procedures.select("procedure_id", "procedure"), ["procedure_id"], how)
        .join(aliases.select("alias_id", "source"), ["alias_id"], how)
        .select("seq", "host", site_of(F.col("host")).alias("site"), "source", "procedure", "total_ms", "db_ms", "component_ms")
    )


def slow_components(
    pages: DataFrame,
    keys: Sequence[str],
    total_ms: str,
    share_ms: str,
    component_ms: str,
    slow_ms: int = fixed.SLOW_MS,
    min_share: float = fixed.VERY_SLOW_SHARE,
    min_seconds: float = 4.0,
    min_count: int = 300,
    deviations: int = 2,
) -> DataFrame:
    """Components of slow pages that are slow at their median and often so.

    Pages count from ``slow_ms`` on when at least ``min_share`` of the time (whole
    numbers: share over total, truncated, for whole-number columns) is the component's side.
    """
    whole = {dict(pages.dtypes)[c] for c in (total_ms, share_ms)} <= {"int", "bigint", "smallint"}
    part = (
        int_div(F.col(share_ms), F.col(total_ms))
        if whole
        else F.try_divide(F.col(share_ms), F.col(total_ms))
    )
    slow = pages.filter((F.col(total_ms) >= slow_ms) & (part >= min_share) & (F.col(component_ms) > 0))
    spread = group_spread(slow, keys, component_ms).filter(
        F.col("deviation").isNotNull() & (F.col("median") / 1000 > min_seconds)
    )
    often = (F.col("rows") - F.col("median") / 1000) > F.col("deviation") / 1000 * deviations
    seconds = F.col("total").cast("decimal(28,3)") / 1000 / F.col("rows")
    return (
        spread.filter(often & (F.col("rows") > min_count))
        .select(*keys, F.col("rows").alias("occurrences"), seconds.cast("decimal(18,3)").alias("average_seconds"))
        .orderBy(F.col("occurrences").desc(), *keys)
    )


def slow_servers(log: DataFrame, group: Mapping[str, Column], host: str, minutes: int, deviations: int = 2) -> DataFrame:
    """Hosts with far more slow pages than the median host of their group."""
    keys = list(group)
    counts = log.groupBy(*[c.alias(k) for k, c in group.items()], host).agg(F.count(F.lit(1)).alias("slow_pages"))
    return high_outliers(counts, keys, "slow_pages", minutes, deviations, cells=1).select(
        *keys,
        host,
        "slow_pages",
        "average",
        "median",
        F.col("deviation").cast("bigint").alias("deviation"),
    ).orderBy(*keys, F.col("slow_pages").desc(), host)


def slow_sources(
    pages: DataFrame, host: str, source: str, total_ms: str, share_ms: str, site: Column, min_ratio: float = 0.5,
    min_count: int = 1000, sites: tuple[str, str] = fixed.SITE_LABELS,
) -> DataFrame:
    """Data sources that take most of the page time on many hosts.

    Averages per host and source are whole numbers; ratios are averaged over hosts.
    """
    totals = pages.groupBy(host, source).agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_when(site == label).alias(f"_{label}") for label in sites],
        int_div(F.sum(total_ms), F.count(total_ms)).alias("_total"),
        int_div(F.sum(share_ms), F.count(share_ms)).alias("_share"),
    )
    ratio = F.try_divide(F.col("_share").cast("decimal(20,2)"), F.col("_total").cast("decimal(20,2)"))
    return (
        totals.withColumn("_ratio", ratio.cast("decimal(18,6)"))
        .filter(F.col("_ratio") > min_ratio)
        .groupBy(source)
        .agg(
            F.sum("_n").alias("total"),
            *[F.sum(f"_{label}").alias(label.lower()) for label in sites],
            F.sum("_total").alias("total_time"),
            F.sum("_share").alias("share_time"),
            F.avg("_ratio").cast("decimal(18,4)").alias("ratio"),
        )
        .filter(F.col("total") > min_count)
        .orderBy(F.col("total").desc(), source)
    )


def timeouts(log: DataFrame, ts: str, keys: Sequence[str], as_of: Moment, minutes: int = 20, min_count: int = 10) -> DataFrame:
    """Counts per key in the last minutes, above a minimum."""
    return (
        rolling_window(log, ts, as_of, minutes)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("metric_value"))
        .filter(F.col("metric_value") > min_count)
        .orderBy(*keys)
    )
