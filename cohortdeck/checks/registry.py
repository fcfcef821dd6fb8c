"""The list of checks: a Spark query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, ShortType, TimestampNTZType, TimestampType

from cohortdeck.checks.entities import Tables
from cohortdeck.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Plain types any two engines hand over alike: days and times as text, decimals as doubles."""
    cells = []
    for field in df.schema:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, TimestampNTZType | TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, DecimalType):
            column = column.cast("double")
        elif isinstance(kind, IntegerType | ShortType):
            column = column.cast("bigint")
        cells.append(column.alias(field.name))
    return df.select(*cells)


def check(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables)`` under ``name`` with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: portable(fn(Tables(tune(spark), sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sql_rate(part: str, whole: str, places: int = 4, empty: str = "NULL") -> str:
    """SQL for ``part / whole`` of non-negative whole numbers, rounded half up exactly."""
    scale = 10**places
    return (
        f"CASE WHEN ({whole}) > 0 THEN CAST((2 * CAST({part} AS HUGEINT) * {scale} + ({whole})) "
        f"// (2 * CAST({whole} AS HUGEINT)) AS DOUBLE) / {scale} ELSE {empty} END"
    )
