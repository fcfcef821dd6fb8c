"""Join shapes.  No side is ever hinted for broadcast: Spark measures and decides.

Where only the existence of a partner matters the partner side is reduced to one
row per key first, so a key that holds much of the data never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the left key columns are kept.

    Without keys the right side is one row, which each left row gets.
    """
    if not keys:
        names = right.columns
        if not names:
            return left
        only = right.select(F.struct(*names)).scalar()
        return left.withColumn("_only", only).select(*left.columns, *[F.col(f"_only.{c}").alias(c) for c in names])
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])


def with_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other`` (semi-join on its distinct keys)."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def without_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``; rows with a null key stay."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``column NOT IN (SELECT other_column FROM other)`` with its null rules.

    Spark's own null-aware anti-join always broadcasts the other side.  Here the
    other side is shuffled like any join and its nulls are a one-row subquery.
    """
    keys = other.select(F.col(other_column).alias(column)).distinct()
    size = keys.agg(F.count(F.lit(1))).scalar()
    nulls = keys.agg(F.count_if(F.col(column).isNull())).scalar()
    kept = df.join(keys.filter(F.col(column).isNotNull()), [column], "left_anti")
    return kept.filter((size == 0) | ((nulls == 0) & F.col(column).isNotNull())).select(*df.columns)


def optional_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_filter: Column) -> DataFrame:
    """Left join to the rows of ``right`` passing the filter; no left row is lost."""
    return left.join(right.filter(right_filter), list(keys), "left")


def with_role(df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, columns: dict[str, str]) -> DataFrame:
    """Attributes of a dimension under role names, e.g. both users of a message.

    ``columns`` maps dimension columns to the names they get.
    """
    role = dimension.select(
        F.col(dimension_key).alias(key), *[F.col(c).alias(name) for c, name in columns.items()]
    )
    return df.join(role, [key])


def preceded_by(
    df: DataFrame, ts: str, earlier: DataFrame, earlier_ts: str, keys: Sequence[str]
) -> DataFrame:
    """Rows with an ``earlier`` row of the same key strictly before them, each once."""
    first = earlier.groupBy(*keys).agg(F.min(earlier_ts).alias("_first"))
    return df.join(first, list(keys)).filter(F.col("_first") < F.col(ts)).select(*df.columns)


def at_first_event(df: DataFrame, keys: Sequence[str], ts: str, first: DataFrame | None = None) -> DataFrame:
    """Rows at their key's first time; rows tied at that time all stay.

    ``first`` may hold first times (columns ``keys`` and ``ts``) of another set.
    The time is part of the join key, which spreads the rows of a busy key.
    """
    if first is None:
        first = df.groupBy(*keys).agg(F.min(ts).alias(ts))
    return df.join(first.select(*keys, ts).distinct(), [*keys, ts], "left_semi")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """Join whose left rows of one key are spread over ``salts`` tasks.

    For row-level joins on a key known to be hot, where the adaptive split of the
    session is off or too coarse.  The right side is repeated ``salts`` times, so
    it should be the small one.  Left rows stay whole; ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps left rows once: use inner or left")
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
