"""Date and time expressions with SQL Server's counting rules."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = str | date | datetime | Column


def moment(value: Moment) -> Column:
    """A zone-free timestamp.  Literals fold, so filters on them reach the scan."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def calendar_day(value: Moment) -> Column:
    """A date literal (or the date part of a column)."""
    if isinstance(value, Column):
        return F.to_date(value)
    return F.lit(str(value)[:10]).cast("date")


def midnight(value: Moment) -> Column:
    """The start of the day of ``value`` as a timestamp, for prunable day bounds."""
    return calendar_day(value).cast("timestamp_ntz")


def shift(ts: Moment, amount: int | Column, unit: str) -> Column:
    """``ts`` moved by ``amount`` SECOND/MINUTE/HOUR/DAY/MONTH/YEAR; month ends clamp."""
    quantity = amount if isinstance(amount, Column) else F.lit(int(amount))
    return F.timestamp_add(unit.upper(), quantity, moment(ts))


def shift_days(day: Moment, amount: int) -> Column:
    """A date moved by whole days, kept as a date."""
    return F.date_add(calendar_day(day), amount)


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(end, start)


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed: 0.9 s to 1.1 s counts as 1."""
    clock = [F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c) for c in (start, end)]
    return F.datediff(end, start).cast("bigint") * 86400 + clock[1] - clock[0]


def us_week(ts: Column) -> Column:
    """Week of the year with weeks starting on Sunday and 1 January in week 1."""
    new_year_weekday = F.dayofweek(F.trunc(ts, "year"))
    return F.floor((F.dayofyear(ts) + new_year_weekday - 2) / 7).cast("int") + 1


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def age_in_years(birth: Column, at: Column) -> Column:
    """Days lived over 365, rounded down (leap days are not corrected)."""
    return F.floor(F.datediff(at, birth) / 365).cast("int")
