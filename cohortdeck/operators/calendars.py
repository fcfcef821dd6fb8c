"""Gap-free day spines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortdeck.functions.times import Moment, calendar_day


def day_spine(spark: SparkSession, start: Moment, end: Moment, name: str = "day") -> DataFrame:
    """Every day from ``start`` to ``end``, both included; a few rows per year."""
    days = F.sequence(calendar_day(start), calendar_day(end))
    return spark.range(1).select(F.explode(days).alias(name))


def fill_days(
    daily: DataFrame, day: str, start: Moment, end: Moment, zero: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """``daily`` with a row for every day; ``zero`` columns get 0 where absent.

    The daily table is already summed, so the spine never meets raw rows.
    """
    full = day_spine(daily.sparkSession, start, end, day).join(daily, [day], "left")
    return full.fillna(0, subset=list(zero)) if zero else full
