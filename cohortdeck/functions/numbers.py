"""Rates, integer division and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column, precision: int = 18, scale: int = 2) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def int_div(dividend: Column, divisor: Column) -> Column:
    """Whole-number quotient truncated toward zero; null when the divisor is 0."""
    safe = F.nullif(divisor, F.lit(0).cast("bigint"))
    return F.call_function("div", dividend.cast("bigint"), safe.cast("bigint"))


def nullable_rate(part: Column, whole: Column) -> Column:
    """``part / whole``, null when ``whole`` is 0 or null."""
    return F.try_divide(part, whole)


def safe_rate(part: Column, whole: Column, precision: int = 18, scale: int = 4) -> Column:
    """``part / whole`` at the declared scale, 0 when either is 0 or missing."""
    wide = [c.cast("decimal(20,2)") for c in (part, whole)]
    ratio = F.try_divide(F.nullif(wide[0], F.lit(0)), wide[1])
    kind = f"decimal({precision},{scale})"
    return F.coalesce(ratio.cast(kind), F.lit(0).cast(kind))


def percent(part: Column, whole: Column, precision: int = 10, scale: int = 2) -> Column:
    """``part / whole`` in percent at a declared scale, null for an empty whole."""
    ratio = F.try_divide(part.cast("decimal(20,2)"), whole.cast("decimal(20,2)"))
    return (ratio * 100).cast(f"decimal({precision},{scale})")


def lift_percent(value: Column, control: Column) -> Column:
    """Percent change of ``value`` against the control's."""
    ratio = F.try_divide(value.cast("decimal(20,2)"), control.cast("decimal(20,2)"))
    return ((ratio - 1) * 100).cast("decimal(36,2)")
