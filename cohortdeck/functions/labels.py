"""Labels from codes, bands and ordered rules; cohorts from GUID digits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.texts import char_at
from cohortdeck.functions.times import Moment, moment


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Label of the first true rule; ``default`` (null unless given) when none is."""
    chain = F
    for test, label in rules:
        chain = chain.when(test, label if isinstance(label, Column) else F.lit(label))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def code_label(code: Column, labels: Mapping, default: object = None) -> Column:
    """Decode a code by a table; unknown and null codes get ``default``."""
    return first_match([(code == key, label) for key, label in labels.items()], default)


def band(value: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """``labels[i]`` for values up to and including ``edges[i]``, the last above all.

    Null stays null.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("a band list needs one label more than edges")
    rules = [(value <= F.lit(edge), label) for edge, label in zip(edges, labels)]
    rules.append((value > F.lit(edges[-1]), labels[-1]))
    return first_match(rules)


def package_months(days: Column, edges: Sequence[int] = fixed.PACKAGE_DAY_EDGES) -> Column:
    """Package length in months from its length in days."""
    rules = [(days <= edge, months) for edge, months in zip(edges, fixed.PACKAGE_DAY_MONTHS)]
    return first_match([*rules, (days > edges[-1], fixed.PACKAGE_DAY_MONTHS[-1])])


def letter_of(number: Column) -> Column:
    """1 to A, 2 to B ... 26 to Z; null outside."""
    return F.when(number.between(1, 26), F.chr(number.cast("bigint") + 64))


def cohort_digit(guid: Column, position: int) -> Column:
    """The hex digit of a GUID that decides the cohort, in upper case."""
    return F.upper(char_at(guid, position))


def digit_cohort(digit: Column, cohorts: Mapping[str, str], default: str | None = None) -> Column:
    """Cohort whose digit string holds the digit, e.g. ``{"Control": "0123"}``.

    Without ``default`` a digit in no list has no cohort (null).
    """
    rules = [(digit.isin(*digits), label) for label, digits in cohorts.items()]
    return first_match(rules, default)


def dated_cohort(
    digit: Column,
    ts: Column,
    schedule: Sequence[tuple[str, str, Moment, Moment | None]],
    default: str = "Control",
) -> Column:
    """Cohort by digit and date.  Schedule rows: label, digits, from, up to (exclusive)."""
    rules = []
    for label, digits, start, end in schedule:
        test = digit.isin(*digits) & (ts >= moment(start))
        rules.append((test if end is None else test & (ts < moment(end)), label))
    return first_match(rules, default)
