"""Running totals, interval counts and exact order statistics without big groups.

A running total over one key would put all its rows into one task.  Here the rows
of a key are cut into ordered cells (hours, or ranges of the value).  Totals run
inside each cell, and a cell's starting offset comes from the small table of cell
totals, so a key holding a third of the data is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from cohortdeck.operators.joins import null_safe_join


def running_total(
    df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[str], weights: dict[str, str]
) -> DataFrame:
    """Add per-key running sums: ``weights`` maps result columns to weight columns.

    ``cell`` must not decrease along ``order``.  Offsets join by plain equality, which
    keeps the partitioning of the sums inside cells; a row with a null key or cell gets
    the sum inside its own (null) cell only.
    """
    inside = Window.partitionBy(*keys, cell).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, cell).agg(*[F.sum(w).alias(f"_t_{out}") for out, w in weights.items()])
    offsets = totals.select(
        *keys,
        cell,
        *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_o_{out}") for out in weights],
    )
    local = df.select(
        "*",
        *[
            F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_l_{out}")
            for out, w in weights.items()
        ],
    )
    joined = local.join(offsets, [*keys, cell], "left")
    return joined.select(
        *df.columns, *[(F.col(f"_l_{out}") + F.coalesce(F.col(f"_o_{out}"), F.lit(0))).alias(out) for out in weights]
    )


def _cell(grain: str) -> Column:
    """Number of the minute, hour, day, month or year of ``_at``, free of time zones."""
    at = F.col("_at")
    day = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date"))
    cells = {
        "minute": (day * 24 + F.hour(at)) * 60 + F.minute(at),
        "hour": day * 24 + F.hour(at),
        "day": day,
        "month": F.year(at) * 12 + F.month(at),
        "year": F.year(at),
    }
    return cells[grain]


def interval_sums(
    intervals: DataFrame,
    interval_id: Sequence[str],
    begin: Column,
    end: Column | None,
    points: DataFrame,
    point_ts: str,
    keys: Sequence[str],
    weights: dict[str, Column],
    end_closed: bool = True,
    grain: str = "hour",
) -> DataFrame:
    """Sum point weights with ``begin <= ts <= end`` for every interval row.

    ``interval_id`` names columns that identify an interval row; ``end`` None means
    no upper bound, ``end_closed`` False excludes it.  Intervals and points meet on
    a shared timeline, so no pair of them is ever formed.  Empty sums are 0; null keys
    and bounds, and a begin after its end, match nothing.  Weights are whole numbers or
    decimals: the sums are differences of running totals, which lose digits in doubles.
    """
    names = list(weights)
    packed = points.dropna(subset=[*keys, point_ts]).groupBy(*keys, F.col(point_ts).alias("_at")).agg(
        *[F.sum(w).alias(f"_w_{n}") for n, w in weights.items()]
    )
    inexact = [n for n in names if not isinstance(packed.schema[f"_w_{n}"].dataType, IntegralType | DecimalType)]
    if inexact:
        raise TypeError(f"interval sums need whole numbers or decimals: {', '.join(inexact)}")
    stream = packed.select(*keys, "_at", F.lit(1).alias("_turn"), *[f"_w_{n}" for n in names])
    id_type = F.struct(*interval_id)
    forward = begin.isNotNull() if end is None else begin <= end
    bounds = [(begin, 0, -1)]
    # an open end is placed after everything; a closed one after its own instant
    open_end = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
    bounds.append((open_end, 2, 1) if end is None else (end, 2 if end_closed else 0, 1))
    marks = intervals.select(
        *keys,
        id_type.alias("_id"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.when(forward, at.cast("timestamp_ntz")).alias("_at"),
                        F.lit(turn).alias("_turn"),
                        F.lit(sign).alias("_sign"),
                    )
                    for at, turn, sign in bounds
                ]
            )
        ).alias("_m"),
    ).select(*keys, "_id", "_m.*", *[F.lit(0).alias(f"_w_{n}") for n in names])
    line = stream.unionByName(marks, allowMissingColumns=True).withColumn("_cell", _cell(grain))
    ran = running_total(line, keys, "_cell", ["_at", "_turn"], {n: f"_w_{n}" for n in names})
    sums = (
        ran.filter(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(*[F.sum(F.col(n) * F.col("_sign")).alias(n) for n in names])
    )
    return sums.select("_id.*", *names)


def interval_counts(
    intervals: DataFrame,
    interval_id: Sequence[str],
    begin: Column,
    end: Column | None,
    points: DataFrame,
    point_ts: str,
    keys: Sequence[str],
    name: str,
    **options,
) -> DataFrame:
    """Number of points inside each interval (see ``interval_sums``)."""
    return interval_sums(
        intervals, interval_id, begin, end, points, point_ts, keys, {name: F.lit(1)}, **options
    )


def covering_count(
    points: DataFrame,
    point_ts: str,
    intervals: DataFrame,
    begin: str,
    end: str,
    keys: Sequence[str],
    name: str,
    grain: str = "hour",
) -> DataFrame:
    """Add to each point the number of intervals with ``begin <= ts < end``."""
    payload = F.struct(*[F.col(c) for c in points.columns])
    valid = intervals.dropna(subset=list(keys)).filter(F.col(begin) < F.col(end))
    steps = [
        valid.select(*keys, F.col(at).alias("_at"), F.lit(step).alias("_w"))
        for at, step in ((begin, 1), (end, -1))
    ]
    marks = (
        steps[0]
        .unionByName(steps[1])
        .groupBy(*keys, "_at")
        .agg(F.sum("_w").alias("_w"))
        .withColumn("_turn", F.lit(0))
    )
    rows = points.select(
        *keys, F.col(point_ts).alias("_at"), F.lit(0).cast("bigint").alias("_w"), F.lit(1).alias("_turn"), payload.alias("_row")
    )
    line = rows.unionByName(marks, allowMissingColumns=True).withColumn("_cell", _cell(grain))
    ran = running_total(line, keys, "_cell", ["_at", "_turn"], {name: "_w"})
    return ran.filter(F.col("_row").isNotNull()).select("_row.*", name)


def _search_sql(low: int, high: int) -> str:
    """SQL for the number of ascending cuts below the value, found by halving."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    lower, upper = _search_sql(low, middle), _search_sql(middle + 1, high)
    return f"CASE WHEN _number <= _grid.cuts[{middle}] THEN {lower} ELSE {upper} END"


def _number(df: DataFrame, value: str) -> Column:
    """A number that rises with the column: times in microseconds, of texts the first bytes."""
    kind, column = dict(df.dtypes)[value], F.col(value)
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def value_cells(counts: DataFrame, keys: Sequence[str], value: str, coarse: int = 32) -> DataFrame:
    """Add ``_cell``, an ordered range of a group's values, to (keys, value, ...), one row per value.

    Coarse ranges come from approximate quantiles of each group's different values, summed
    before they move; each is cut evenly, so that a group has about as many cells as
    values in a cell, also where it lies in the tail of the table.  Nothing depends on
    the cuts being exact, only on their order.
    """
    numbered = counts.withColumn("_number", _number(counts, value))
    steps = [i / coarse for i in range(coarse + 1)]
    grid = numbered.groupBy(*keys).agg(
        F.struct(
            F.percentile_approx("_number", steps, 1000).alias("cuts"),
            F.ceil(F.sqrt(F.count(F.lit(1))) / coarse).alias("parts"),
        ).alias("_grid")
    )
    placed = null_safe_join(numbered, grid, keys).withColumn("_range", F.expr(_search_sql(1, coarse)))
    inner = F.expr("width_bucket(_number, _grid.cuts[_range - 1], _grid.cuts[_range], _grid.parts)")
    cell = F.col("_range") * (F.col("_grid.parts") + 2) + F.coalesce(inner, F.lit(0))
    return placed.withColumn("_cell", cell).drop("_grid", "_number", "_range")


def value_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Sequence[Column],
    cells: int = 32,
    needs: DataFrame | None = None,
) -> DataFrame:
    """Distinct values around given ranks: ``_n`` (rows), ``_upto`` (rows up to it), ``_size``.

    ``ranks`` are 1-based and may use ``_size`` and the columns of ``needs`` (one row
    per key).  Only the cells a rank falls into are sorted.  ``cells=1`` ranks a key's
    distinct values in one task and is for values that are counts: D different counts
    add up to at least D * D / 2 rows, so 10**12 rows give under 1.5 million of them.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    group = Window.partitionBy(*keys)
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if cells == 1:
        upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select("*", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(group).alias("_size"))
    counts = value_cells(counts, keys, value, cells)
    totals = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_held"))
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(
        "*",
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_held").over(group).alias("_size"),
    )
    extra = []
    if needs is not None:
        extra = [c for c in needs.columns if c not in keys]
        placed = null_safe_join(placed, needs, keys)
    inside = [(F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_held")) for rank in ranks]
    wanted = placed.filter(reduce(lambda a, b: a | b, inside)).drop("_held")
    upto = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = null_safe_join(counts, wanted, [*keys, "_cell"])
    return near.select(
        *keys, value, "_n", (F.col("_before") + F.sum("_n").over(upto)).alias("_upto"), "_size", *extra
    )


def _holds(rank: Column) -> Column:
    return (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", cells: int = 32) -> DataFrame:
    """Median per key: half of (largest of the lower half + smallest of the upper half).

    Halves round up.  Whole-number input gives a whole number, truncated.
    """
    ranks = {"_low": F.floor((F.col("_size") + 1) / 2), "_high": F.floor(F.col("_size") / 2) + 1}
    ranked = value_ranks(df, keys, value, list(ranks.values()), cells)
    middle = ranked.groupBy(*keys).agg(
        *[F.min(F.when(_holds(rank), F.col(value))).alias(n) for n, rank in ranks.items()]
    )
    total = F.col("_low") + F.col("_high")
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    half = F.call_function("div", total.cast("bigint"), F.lit(2).cast("bigint")) if whole else total / 2
    return middle.select(*keys, half.alias(name))
