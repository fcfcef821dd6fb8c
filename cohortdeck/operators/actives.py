"""Exact distinct counts that can be kept per day and merged later.

A day's users are a set of bitmaps: user numbers are cut into buckets of 32,768, and each
bucket with a user is one row with a bit per user (4 KB).  Bitmaps of days are merged by
OR, so weeks, months and rolling windows come from the stored days and never from the log.
User numbers are whole and not negative, and close together for the rows to be well filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_bitmaps(log: DataFrame, ts: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, bucket, users): who was there, per day; unknown users and times are nobody.

    Bits are set before rows move, so a day's flood of rows shrinks to its users.
    """
    known = log.filter(F.col(unit).isNotNull() & F.col(ts).isNotNull())
    bucket = F.bitmap_bucket_number(F.col(unit)).alias("bucket")
    return known.groupBy(*keys, F.to_date(ts).alias("day"), bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(unit))).alias("users"))


def merged_days(stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key, day and bucket of stored bitmaps, also where a day was stored in parts."""
    return stored.groupBy(*keys, "day", "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def actives(bitmaps: DataFrame, period: Column, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct users per key and period of the day, e.g. its week."""
    merged = bitmaps.groupBy(*keys, period.alias(name), "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*keys, name).agg(F.sum(F.bitmap_count("users")).alias("actives"))


def rolling_actives(bitmaps: DataFrame, days: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct users per key of each day and the ``days - 1`` before it, for days up to the last one stored.

    Each day's bitmaps are handed on to the days whose window they belong to.
    """
    last = bitmaps.agg(F.max("day")).scalar()
    ahead = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_ahead")
    handed = bitmaps.select(*keys, "day", "bucket", "users", ahead).withColumn("day", F.date_add("day", F.col("_ahead")))
    return actives(handed.filter(F.col("day") <= last), F.col("day"), "day", keys)
