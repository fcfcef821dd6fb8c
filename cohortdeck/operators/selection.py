"""Exact order statistics from sorted ranges, for numbers, times and texts alike.

Rows are dealt out by ranges of (keys, value): Spark samples the values themselves, so texts
with a common beginning or numbers of any spread are cut as evenly as others, and a group
with much of the data is spread over many ranges.  The ranges are written once, and from
then on a range is a number.  Where a rank lies is found on the sums of groups and ranges,
and only the ranges that hold a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.operators.joins import null_safe_join
from cohortdeck.sources.tables import staged


def sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_range``, which never falls along (keys, order); equal rows share one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def range_sums(ranges: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per group and range: ``_held`` rows, ``_before`` in the group's earlier ranges, ``_size`` of the group."""
    held = F.count(F.lit(1)) if weight is None else F.sum(weight)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.groupBy(*keys, "_range").agg(held.alias("_held")).select(
        "*", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"), F.sum("_held").over(group).alias("_size")
    )


def discrete_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Per group, the smallest value with at least the share of all rows up to it.

    ``shares`` maps result columns to (part, whole), so the middle is (1, 2) and the upper tenth
    (9, 10).  Rows without a value don't count; a group without values has no row.  Rows are
    summed per value first, so a value that is met everywhere is one row of its range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranges = sorted_ranges(counts, keys, [value])
    ranks = [
        F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.call_function("div", F.col("_size") * part + whole - 1, F.lit(whole))).alias("rank"))
        for name, (part, whole) in shares.items()
    ]
    wanted = range_sums(ranges, keys, "_n").withColumn("_want", F.explode(F.array(*ranks)))
    wanted = wanted.filter((F.col("_before") < F.col("_want.rank")) & (F.col("_want.rank") <= F.col("_before") + F.col("_held")))
    near = null_safe_join(ranges, wanted.select(*keys, "_range", "_before", "_want"), [*keys, "_range"])
    upto = Window.partitionBy(*keys, "_range", "_want").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    hit = placed.filter((F.col("_upto") >= F.col("_want.rank")) & (F.col("_upto") - F.col("_n") < F.col("_want.rank")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_want.name") == name, F.col(value))).alias(name) for name in shares])


def top_half(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str) -> DataFrame:
    """The lower half of each group by ``value``, rounded up; ``tiebreak`` is unique.

    Rows without a value don't count and are not returned.  Ranges that lie wholly in the half
    are taken as they are, those wholly above it are left, and the one between is sorted.
    """
    ranges = sorted_ranges(df.filter(F.col(value).isNotNull()), keys, [value, tiebreak])
    half = F.call_function("div", F.col("_size") + 1, F.lit(2))
    sums = range_sums(ranges, keys).filter(F.col("_before") < half)
    met = null_safe_join(ranges, sums, [*keys, "_range"])
    whole = met.filter(F.col("_before") + F.col("_held") <= half)
    cut = met.filter(F.col("_before") + F.col("_held") > half)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value, tiebreak))
    kept = cut.withColumn("_place", place).filter(F.col("_before") + F.col("_place") <= half)
    return whole.select(*df.columns).unionByName(kept.select(*df.columns))
