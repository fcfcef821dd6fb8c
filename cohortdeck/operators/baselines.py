"""Comparing a period with its own past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.functions.numbers import int_div
from cohortdeck.functions.times import Moment, calendar_day, shift
from cohortdeck.operators.joins import null_safe_join
from cohortdeck.operators.timeline import exact_median


def day_against_average(
    daily: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    target: Moment,
    averaged_before: Moment,
    min_value: int,
    factor: float,
    decimal_ratio: bool = False,
) -> DataFrame:
    """Keys whose ``target`` day is busy and far from their average earlier day.

    ``daily`` has one row per key and day.  Both sides come out of one pass.  The
    average and the ratio use whole-number division unless ``decimal_ratio``, so
    by default any ``factor`` below 1 asks for at least a doubling or a fall to 0.
    Result: keys, ``on_day``, ``earlier_total``, ``earlier_days`` and ``average`` (null
    when there is no earlier day).
    """
    is_target = F.col(day) == calendar_day(target)
    is_earlier = F.col(day) < calendar_day(averaged_before)
    sides = daily.filter(is_target | is_earlier).groupBy(*keys).agg(
        F.sum(F.when(is_target, F.col(value))).alias("on_day"),
        F.sum(F.when(is_earlier, F.col(value))).alias("earlier_total"),
        F.count_if(is_earlier).alias("earlier_days"),
    ).withColumn("average", int_div(F.col("earlier_total"), F.col("earlier_days")))
    now, usual = F.col("on_day"), F.coalesce(F.col("average"), F.lit(0))
    gap = F.abs(now - usual)
    ratio = F.try_divide(gap.cast("double"), usual.cast("double")) if decimal_ratio else int_div(gap, usual)
    return sides.filter((now > min_value) & ((usual == 0) | (ratio > factor)))


def hourly_baselines(log: DataFrame, ts: str, keys: Sequence[str], weeks: int = 4) -> DataFrame:
    """Counts per hour with the previous hour's, yesterday's and the same weekday's average (see ``baselines_of``)."""
    hourly = log.groupBy(*keys, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour")).agg(
        F.count(F.lit(1)).alias("executions")
    )
    start = shift(F.col("_day").cast("timestamp_ntz"), F.col("_hour"), "HOUR")
    return baselines_of(hourly.select(*keys, start.alias("hour_start"), "executions"), keys, weeks)


def baseline_lags(weeks: int = 4) -> list[tuple[str, int]]:
    """The hours an hour is compared with: role and distance."""
    return [("previous", 1), ("yesterday", 24), *[("weekly", 24 * 7 * w) for w in range(1, weeks + 1)]]


def baselines_of(hourly: DataFrame, keys: Sequence[str], weeks: int = 4, wanted: DataFrame | None = None) -> DataFrame:
    """Baselines of hourly counts (keys, ``hour_start``, ``executions``), one row per key and hour.

    Each hourly count is handed on to the later hours it serves as a baseline for,
    then all contributions of an hour meet in one aggregation (no self-joins).  The
    weekly average is over the weeks that have the hour, in whole numbers.  With
    ``wanted`` (keys and hours) only those hours are worked out.
    """
    served = F.explode(
        F.array(*[F.struct(F.lit(role).alias("role"), F.lit(lag).alias("lag")) for role, lag in [("now", 0), *baseline_lags(weeks)]])
    )
    moved = hourly.select(*keys, F.col("hour_start").alias("_start"), F.col("executions").alias("_n"), served.alias("_s")).select(
        *keys, shift(F.col("_start"), F.col("_s.lag"), "HOUR").alias("hour_start"), F.col("_s.role").alias("_role"), "_n"
    )
    if wanted is not None:
        moved = null_safe_join(moved, wanted.select(*keys, "hour_start").distinct(), [*keys, "hour_start"], "left_semi")

    def of(role: str) -> Column:
        return F.when(F.col("_role") == role, F.col("_n"))

    return (
        moved.groupBy(*keys, "hour_start")
        .agg(
            F.sum(of("now")).alias("executions"),
            F.sum(of("previous")).alias("previous_hour"),
            F.sum(of("yesterday")).alias("yesterday"),
            int_div(F.sum(of("weekly")), F.count(of("weekly"))).alias("weekly_average"),
        )
        .filter(F.col("executions").isNotNull())
    )


def touched_hours(changed: DataFrame, keys: Sequence[str], weeks: int = 4) -> DataFrame:
    """The hours whose row of ``baselines_of`` a change of these hours' counts can alter."""
    lag = F.explode(F.array(*[F.lit(lag) for lag in [0, *[lag for _, lag in baseline_lags(weeks)]]])).alias("_lag")
    moved = changed.select(*keys, F.col("hour_start").alias("_start"), lag)
    return moved.select(*keys, shift(F.col("_start"), F.col("_lag"), "HOUR").alias("hour_start")).distinct()


def tiered_alert(
    now: Column,
    weekly: Column,
    previous: Column,
    yesterday: Column,
    new_page: int = 1000,
    times: int = 2,
    catch_all: int = 3000,
    noise: int = 300,
) -> Column:
    """Is this hour's count alarming?  The first baseline that exists decides.

    Weekly average, else previous hour, else yesterday: alarm above ``times`` that.
    Without any: above ``new_page``.  Always above ``catch_all``; never up to ``noise``.
    """
    week, prev, yest = [F.coalesce(c, F.lit(0)) for c in (weekly, previous, yesterday)]
    return (
        (
            ((week == 0) & (yest == 0) & (prev == 0) & (now > new_page))
            | ((week > 0) & (now > times * week))
            | ((week == 0) & (prev > 0) & (now > times * prev))
            | ((week == 0) & (prev == 0) & (yest > 0) & (now > times * yest))
            | (now > catch_all)
        )
        & (now > noise)
    )


def group_spread(df: DataFrame, keys: Sequence[str], value: str, cells: int = 32) -> DataFrame:
    """Per group: ``rows``, ``total``, ``deviation`` (sample), ``average``, ``median``.

    The deviation is of known values and null for one row.

    Pass ``cells=1`` when the values are counts (see ``value_ranks``).
    """
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    average = int_div(F.sum(value), F.count(value)) if whole else F.avg(value)
    basic = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(value).alias("total"),
        F.stddev_samp(F.col(value).cast("double")).alias("deviation"), average.alias("average")
    )
    return null_safe_join(basic, exact_median(df, keys, value, "median", cells), keys, "left")


def low_outliers(
    df: DataFrame, keys: Sequence[str], value: str, deviations: int = 2, miss: float = 0.25, cells: int = 32
) -> DataFrame:
    """Rows below their group's median by over ``deviations`` deviations and ``miss`` more.

    The allowed distance is rounded to a whole number for the miss ratio only.
    """
    spread = null_safe_join(df, group_spread(df, keys, value, cells), keys)
    below = F.col("median") - F.col(value)
    allowed = F.col("deviation") * deviations
    missed = F.try_divide(below.cast("decimal(20,0)"), allowed.cast("decimal(20,0)")) - 1
    return (
        spread.withColumn("allowed_variance", allowed.cast("decimal(20,0)"))
        .withColumn("actual_variance", below)
        .withColumn("miss_ratio", missed.cast("decimal(28,2)"))
        .filter((missed >= F.lit(str(miss)).cast("decimal(28,2)")) & (below > allowed))
    )


def high_outliers(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    floor: int,
    deviations: int = 2,
    over_average: float = 1.5,
    cells: int = 32,
) -> DataFrame:
    """Rows above median by over ``deviations``, above the average and above ``floor``.

    Groups with one row, or with a deviation below 1, flag nothing.
    """
    spread = null_safe_join(df, group_spread(df, keys, value, cells), keys)
    count = F.col(value)
    return spread.filter(
        ((count - F.col("median")) > F.col("deviation") * deviations)
        & (count > F.col("average") * over_average)
        & (count > floor)
        & (F.col("deviation") >= 1)
    )


def trim_high(
    df: DataFrame, keys: Sequence[str], value: str, deviations: float = 1.5, cells: int = 32
) -> DataFrame:
    """Rows under median plus ``deviations`` deviations; one-row groups are dropped."""
    spread = null_safe_join(df, group_spread(df, keys, value, cells), keys)
    return spread.filter(F.col(value) < F.col("median") + F.col("deviation") * deviations).select(*df.columns)


