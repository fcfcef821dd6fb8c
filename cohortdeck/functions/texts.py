"""Text expressions with SQL Server's rules for blanks and positions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def tail(text: Column, length: int) -> Column:
    return F.right(text, F.lit(length))


def char_at(text: Column, position: int) -> Column:
    """Last character of the first ``position`` ones, so a short text yields its last."""
    return tail(head(text, position), 1)


def slice_text(text: Column, start: int, length: int) -> Column:
    """SUBSTRING where positions before 1 use up length: (0, 200) keeps 199 characters."""
    if start < 1:
        start, length = 1, max(length + start - 1, 0)
    return F.substring(text, start, length)


def text_length(text: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(text))


def is_blank(text: Column) -> Column:
    """Null, empty or only blanks."""
    return text_length(F.coalesce(text, F.lit(""))) == 0


def joined_text(*parts: Column | str) -> Column:
    """Concatenation that is null as soon as one part is."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def without(text: Column, piece: str) -> Column:
    return F.replace(text, F.lit(piece), F.lit(""))


def id_shards(number: Column) -> tuple[Column, Column]:
    """The two directory parts made from the last four digits of an id."""
    last_four = tail(number.cast("string"), 4)
    return head(last_four, 2), tail(last_four, 2)


def starts_with_param(text: Column, value: str, escape: bool = True) -> Column:
    """``LIKE value%``.  With ``escape`` the parameter's own wildcards are plain text."""
    return text.startswith(value) if escape else text.like(value + "%")


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """True where one LIKE pattern matches; ``_`` stays a one-character wildcard."""
    return reduce(lambda a, b: a | b, [text.like(p) for p in patterns])


def matches_none(text: Column, patterns: Iterable[str] = (), values: Iterable[str] = ()) -> Column:
    """True where no pattern matches and no value is equal; null text gives null."""
    tests = [~text.like(p) for p in patterns] + [text != v for v in values]
    return reduce(lambda a, b: a & b, tests)
