"""Daily activity by dimension, adoptions, shares and merged daily metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.functions.labels import code_label
from cohortdeck.functions.times import Moment, midnight
from cohortdeck.operators.aggregates import pivot_sum
from cohortdeck.operators.filters import between_moments, closed_days
from cohortdeck.operators.sets import merge_metrics


def daily_by_dimension(
    events: DataFrame,
    ts: str,
    key: str,
    dimension: DataFrame,
    dimension_key: str,
    description: str,
    as_of: Moment,
    days: int = 30,
    keep_keys: Sequence | None = None,
) -> DataFrame:
    """Daily counts by a described dimension over the last whole days.

    Events are counted per day and key before the lookup, so the join sees a few
    rows per day.
    """
    rows = closed_days(events, ts, as_of, days)
    if keep_keys is not None:
        rows = rows.filter(F.col(key).isin(*keep_keys))
    counts = rows.groupBy(F.to_date(ts).alias("metric_date"), key).agg(F.count(F.lit(1)).alias("_n"))
    names = dimension.select(F.col(dimension_key).alias(key), F.col(description))
    return (
        counts.join(names, [key])
        .groupBy("metric_date", description)
        .agg(F.sum("_n").alias("metric_value"))
        .orderBy("metric_date", description)
    )


def adoption(
    adopted: DataFrame,
    ts: str,
    user: str,
    users: DataFrame,
    segment_code: str,
    segments: Mapping,
    start: Moment | None = None,
    as_of: Moment | None = None,
) -> DataFrame:
    """Daily adoptions by the adopter's segment; ``segments`` decodes the user's code."""
    rows = between_moments(adopted, ts, start, None if as_of is None else midnight(as_of))
    per_user = rows.groupBy(F.to_date(ts).alias("metric_date"), user).agg(F.count(F.lit(1)).alias("_n"))
    labelled = per_user.join(users.select(user, segment_code), [user])
    return labelled.groupBy(
        "metric_date", code_label(F.col(segment_code), segments).alias("segment")
    ).agg(F.sum("_n").alias("metric_value"))


def adoption_pivot(adoptions: DataFrame, segments: Mapping[str, str]) -> DataFrame:
    """Adoptions with one column per segment (null where a day has none)."""
    return pivot_sum(adoptions, ["metric_date"], "segment", dict(segments), F.col("metric_value")).orderBy("metric_date")


def daily_share(df: DataFrame, ts: str, flag: Column, start: Moment | None = None) -> DataFrame:
    """Per day: all rows, flagged rows and their percentage (flagged may be null)."""
    daily = between_moments(df, ts, start, None).groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0))).alias("flagged"),
    )
    share = F.col("flagged").cast("decimal(18,0)") / F.col("total") * 100
    return daily.withColumn("flagged_percent", share.cast("decimal(18,4)")).orderBy("day")


def population_share(summary: DataFrame, group: str, size: str) -> DataFrame:
    """Each group's part of the summed population."""
    total = summary.agg(F.sum(size)).scalar()
    share = F.try_divide(F.sum(size).cast("decimal(28,2)"), total.cast("decimal(28,2)"))
    return summary.groupBy(group).agg(share.cast("decimal(18,6)").alias("share")).orderBy(group)


def merged_daily_metrics(
    sources: dict[str, tuple[DataFrame, str]], as_of: Moment, days: int = 30
) -> DataFrame:
    """Daily counts of several logs over the last whole days, one column each."""
    windows = {
        name: (closed_days(rows, ts, as_of, days), F.to_date(ts)) for name, (rows, ts) in sources.items()
    }
    return merge_metrics(windows).orderBy("metric_date")
