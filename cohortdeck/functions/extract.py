"""Values out of XML and JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "\uffff"  # no XML text can hold it, not even as a character reference


def xml_texts(xml: Column, paths: Sequence[str]) -> Column:
    """The texts of the first nodes at ``paths``, empty where absent, in one array: the text is parsed once for all of them.

    Keep it in a column of its own and give that to ``xml_value``.
    """
    parts = f", '{CUT}', ".join(paths) if len(paths) > 1 else f"{paths[0]}, ''"
    return F.split(F.xpath_string(xml, F.lit(f"concat({parts})")), CUT, -1)


def xml_value(xml: Column, path: str, kind: str = "string", among: Sequence[str] | None = None) -> Column:
    """First node at ``path`` cast to ``kind``; null when absent or not castable.

    For several values of one text ``xml`` is what ``xml_texts`` found for the paths ``among``.
    """
    found = F.xpath_string(xml, F.lit(path)) if among is None else F.get(xml, F.lit(list(among).index(path)))
    text = F.nullif(found, F.lit(""))
    return text if kind == "string" else text.try_cast(kind)


def json_value(json: Column, path: str, kind: str = "string") -> Column:
    text = F.get_json_object(json, path)
    return text if kind == "string" else text.try_cast(kind)


def is_true(flag: Column) -> Column:
    """Text flag compared without regard to case; null counts as false."""
    return F.coalesce(F.lower(flag) == "true", F.lit(False))


def xml_record(xml: Column, schema: str) -> Column:
    """The tags right under the root as a struct; absent or bad values are null.

    For several values of one text: it is parsed once, while every ``xml_value`` call
    without ``xml_texts`` parses it again (but reaches any depth).
    """
    return F.from_xml(xml, schema)
