"""Joins by time that hand on rows: the latest row at a time, and every pair of a point and an interval.

Neither puts a key into one task: the first cuts a key's rows into cells of time and
carries the last row over the cells' borders, the second meets points and intervals in
power-of-two cells of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.operators.timeline import _cell


def asof_attributes(
    points: DataFrame,
    point_ts: str,
    history: DataFrame,
    since: str,
    keys: Sequence[str],
    columns: Sequence[str],
    until: str | None = None,
    flag: str = "found",
    grain: str = "day",
) -> DataFrame:
    """Add to each point the ``columns`` of its key's latest history row with ``since <= ts``.

    With ``until`` a latest row that has ended (``until <= ts``) counts as none; an older
    one that still runs doesn't take its place.  ``flag`` tells whether there is a row; without
    one the columns are null.  Of history rows with the same key and time the one with the
    greatest columns counts (nulls least).  Points with a null key or time have none; none
    is lost or repeated.

    A segmented scan: inside each cell of ``grain`` the last row is carried along, and a
    cell starts with the last row of the cells before it, found on a table of one row a
    cell.  So a key with much of the data is worked on by as many tasks as it has cells.
    """
    wanted = [*columns, *([until] if until else [])]
    taken = [c for c in (*columns, flag) if c in points.columns]
    if taken:
        raise ValueError(f"points already have columns: {', '.join(taken)}")
    rows = F.max(F.struct(*wanted)).alias("_held")
    marks = (
        history.dropna(subset=[*keys, since]).groupBy(*keys, F.col(since).alias("_at")).agg(rows)
        .select(*keys, "_at", F.lit(0).alias("_turn"), "_held")
    )
    line = (
        points.select(*keys, F.col(point_ts).alias("_at"), F.lit(1).alias("_turn"), F.struct(*points.columns).alias("_row"))
        .unionByName(marks, allowMissingColumns=True)
        .withColumn("_cell", _cell(grain))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    lasts = line.groupBy(*keys, "_cell").agg(F.max_by("_held", F.when(F.col("_held").isNotNull(), F.col("_at"))).alias("_last"))
    carried = lasts.select(*keys, "_cell", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    local = line.select(*keys, "_cell", "_row", F.last("_held", ignorenulls=True).over(inside).alias("_local"))
    met = local.filter(F.col("_row").isNotNull()).join(carried, [*keys, "_cell"], "left")
    held = F.coalesce(F.col("_local"), F.col("_carried"))
    if until:
        held = F.when(held[until].isNull() | (held[until] > F.col(f"_row.{point_ts}")), held)
    return met.withColumn("_held", held).select(
        "_row.*", F.col("_held").isNotNull().alias(flag), *[F.col("_held")[c].alias(c) for c in columns]
    )


def interval_cells(first: Column, last: Column, levels: int) -> Column:
    """The cells (level, place) of the whole numbers from ``first`` to ``last``, each number in one cell.

    A cell of a level is two of the level below.  At most two cells of each level below the
    top one are used, the rest are cells of the top level ``levels``.
    """

    def at(level: Column) -> Column:
        low = -F.call_function("shiftright", -first, level)
        high = F.call_function("shiftright", last + 1, level) - 1
        odd_low, even_high = low % 2 != 0, high % 2 == 0
        places = F.when(low > high, F.array().cast("array<bigint>")).when(
            level == levels, F.when(low <= high, F.sequence(low, F.greatest(low, high)))
        )
        places = places.otherwise(F.concat(F.when(odd_low, F.array(low)).otherwise(F.array().cast("array<bigint>")), F.when(even_high, F.array(high)).otherwise(F.array().cast("array<bigint>"))))
        return F.transform(places, lambda p: F.struct(level.alias("level"), p.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def point_cells(at: Column, levels: int) -> Column:
    """The cells of every level that hold a whole number."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at, level).alias("place")),
    )


def interval_pairs(
    points: DataFrame,
    at: str,
    intervals: DataFrame,
    begin: Column,
    end: Column,
    keys: Sequence[str],
    end_closed: bool = True,
    unit: int = 60,
    levels: int = 12,
) -> DataFrame:
    """Every pair of a point and an interval of the same key with ``begin <= at <= end``.

    ``begin`` and ``end`` are columns of ``intervals`` or computed from them (such as a bound by
    CASE).  Times are cut into units of ``unit`` seconds and those into cells of one, two,
    four ... units.  An interval is the union of at most two cells a level (and of cells of the
    top level, if it is longer than those), a point lies in one cell a level, and the two meet
    in exactly one cell: an equi-join on key, level and place, whose few excess pairs at the
    interval's ends go by comparing the times.  A key with much of the data is spread by its
    cells.  Null keys, times and bounds, and a begin after its end, meet nothing.  Columns of
    both sides are handed on; other than the keys their names must differ.
    """
    same = [c for c in points.columns if c in intervals.columns and c not in keys]
    if same:
        raise ValueError(f"columns of both sides: {', '.join(same)}")

    def number(column: Column) -> Column:
        return F.floor(F.unix_micros(column.cast("timestamp")) / F.lit(unit * 1_000_000)).cast("bigint")

    bounds = intervals.dropna(subset=list(keys)).withColumns({"_begin": begin, "_end": end}).filter(F.col("_begin") <= F.col("_end"))
    covered = bounds.withColumn("_cell", F.explode(interval_cells(number(F.col("_begin")), number(F.col("_end")), levels)))
    placed = points.dropna(subset=[*keys, at]).withColumn("_cell", F.explode(point_cells(number(F.col(at)), levels)))
    sides = [side.select("*", F.col("_cell.level").alias("_level"), F.col("_cell.place").alias("_place")).drop("_cell") for side in (placed, covered)]
    before_end = (F.col(at) <= F.col("_end")) if end_closed else (F.col(at) < F.col("_end"))
    met = sides[0].join(sides[1], [*keys, "_level", "_place"]).filter((F.col(at) >= F.col("_begin")) & before_end)
    return met.select(*points.columns, *[c for c in intervals.columns if c not in keys])
