"""Aggregation shapes shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.functions.numbers import percent


def count_when(test: Column) -> Column:
    """Rows passing the test; 0 when none does."""
    return F.count_if(test)


def count_when_or_null(test: Column) -> Column:
    """Rows passing the test; null when none does."""
    return F.sum(F.when(test, F.lit(1)))


def distinct_when(unit: str | Column, test: Column) -> Column:
    """Distinct units among the rows passing the test."""
    return F.count_distinct(F.when(test, F.col(unit) if isinstance(unit, str) else unit))


def distinct_flag_counts(
    df: DataFrame, dims: Sequence[str], unit: str, total: str | None, flags: dict[str, Column]
) -> DataFrame:
    """Many conditional distinct counts of one unit in a single pass.

    Rows shrink to one per unit with its flags, which then add up.  The built-in
    rewrite would repeat every row once per distinct count instead.
    """
    known = F.col(unit).isNotNull()
    per_unit = df.groupBy(*dims, unit).agg(
        *[F.max(F.when(test, F.lit(1)).otherwise(F.lit(0))).alias(name) for name, test in flags.items()]
    )
    totals = [] if total is None else [F.count(unit).alias(total)]
    return per_unit.groupBy(*dims).agg(
        *totals,
        *[F.coalesce(F.sum(F.when(known, F.col(name))), F.lit(0)).alias(name) for name in flags],
    )


def first_date_counts(df: DataFrame, unit: str, day: Column, day_name: str, name: str) -> DataFrame:
    """How many units have their first row on each day."""
    firsts = df.groupBy(unit).agg(F.min(day).alias(day_name))
    return firsts.groupBy(day_name).agg(F.count(unit).alias(name))


def percent_of_total(df: DataFrame, measure: str, name: str, total: Column | None = None) -> DataFrame:
    """Share of each row's measure in the sum over all rows (a one-row subquery).

    ``total`` may bring a cheaper way to that sum, e.g. a plain count of the source.
    """
    if total is None:
        total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(name, percent(F.col(measure), total))


def dataset_totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row with the sums a report shows under a dataset."""
    return df.agg(*[F.sum(m).alias(m) for m in measures])


def pivot_sum(
    df: DataFrame, rows: Sequence[str], column: str, values: dict, measure: Column, empty_zero: bool = False
) -> DataFrame:
    """One summed column per listed value; ``values`` maps values to column names."""
    cells = []
    for value, name in values.items():
        cell = F.sum(F.when(F.col(column) == value, measure))
        cells.append((F.coalesce(cell, F.lit(0)) if empty_zero else cell).alias(name))
    return df.groupBy(*rows).agg(*cells)


def top_rows(df: DataFrame, n: int, by: str, tiebreak: Sequence[str]) -> DataFrame:
    """The ``n`` largest rows; ties are settled by ``tiebreak`` so results repeat."""
    return df.orderBy(F.col(by).desc(), *tiebreak).limit(n)
