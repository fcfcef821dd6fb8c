"""Time-window filters.  Bounds are literals, so they reach the file scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.functions.times import Moment, midnight, moment, shift, shift_days


def between_moments(df: DataFrame, ts: str, start: Moment | None, end: Moment | None) -> DataFrame:
    """Rows with ``start <= ts < end``; an open side is None."""
    if start is not None:
        df = df.filter(F.col(ts) >= moment(start))
    if end is not None:
        df = df.filter(F.col(ts) < moment(end))
    return df


def rolling_window(df: DataFrame, ts: str, as_of: Moment, amount: int, unit: str = "MINUTE") -> DataFrame:
    """Rows of the last ``amount`` units before ``as_of`` (no upper bound)."""
    return df.filter(F.col(ts) >= shift(as_of, -amount, unit))


def lagged_window(
    df: DataFrame, ts: str, as_of: Moment, oldest: int, newest: int, unit: str = "MINUTE"
) -> DataFrame:
    """Rows between ``oldest`` and ``newest`` units before ``as_of``, newest excluded."""
    return between_moments(df, ts, shift(as_of, -oldest, unit), shift(as_of, -newest, unit))


def closed_days(df: DataFrame, ts: str, as_of: Moment, days: int) -> DataFrame:
    """The last ``days`` whole days; the day of ``as_of`` is left out."""
    return between_moments(df, ts, midnight(shift_days(as_of, -days)), midnight(as_of))


def same_day(df: DataFrame, ts: str, as_of: Moment) -> DataFrame:
    return between_moments(df, ts, midnight(as_of), midnight(shift_days(as_of, 1)))


def on_weekdays(df: DataFrame, ts: str, weekend: Sequence[int] = (1, 7)) -> DataFrame:
    """Rows not on the given days (1 is Sunday)."""
    return df.filter(~F.dayofweek(ts).isin(*weekend))


def differs_or_null(column: Column, value: object) -> Column:
    """``column <> value OR column IS NULL``."""
    return ~column.eqNullSafe(F.lit(value))
