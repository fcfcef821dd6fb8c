"""Appending and merging row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, matched by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_metrics(sources: dict[str, tuple[DataFrame, Column]], day_name: str = "metric_date") -> DataFrame:
    """Daily row counts of several tables side by side, 0 where a table has none.

    ``sources`` maps a metric to (rows, day expression).  Every source is counted
    before the union, so only daily rows are merged.
    """
    names = list(sources)
    parts = []
    for metric, (rows, day) in sources.items():
        daily = rows.groupBy(day.alias(day_name)).agg(F.count(F.lit(1)).alias(metric))
        parts.append(
            daily.select(
                day_name, *[F.col(n) if n == metric else F.lit(0).cast("bigint").alias(n) for n in names]
            )
        )
    return append(*parts).groupBy(day_name).agg(*[F.sum(n).alias(n) for n in names])
