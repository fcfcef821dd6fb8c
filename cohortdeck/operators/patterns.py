"""Texts classified by a table of LIKE patterns of any length.

Every pattern is listed under a piece that a match must have: its literal beginning, end,
or longest literal run.  Texts meet the patterns of their own beginnings, ends and runs in
an equi-join, and ``LIKE`` itself decides, so no text is compared with all patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.operators.joins import null_safe_join
from cohortdeck.sources.tables import staged

LITERAL = r"[^%_\\]+"
LONGEST = 24  # letters of a beginning or end that are listed; more would only part patterns further
RUN = 8  # the same for runs inside
SPREAD = 64  # keys that patterns without a literal are listed under


def pattern_index(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``patterns`` with _kind (start, end, run, any), _length and _piece; one row each, ``SPREAD`` for ``any``."""
    text = F.col(pattern)
    start = F.left(F.regexp_extract(text, rf"^{LITERAL}", 0), F.lit(LONGEST))
    end = F.right(F.regexp_extract(text, rf"{LITERAL}$", 0), F.lit(LONGEST))
    runs = F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))
    longest = F.reduce(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    run = F.left(longest, F.lit(RUN))
    kind = F.when((F.length(start) >= F.length(end)) & (start != ""), "start").when(end != "", "end").when(run != "", "run").otherwise("any")
    listed = patterns.withColumn("_kind", kind)
    piece = F.when(kind == "start", start).when(kind == "end", end).when(kind == "run", run)
    pieces = F.when(kind == "any", F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda n: n.cast("string"))).otherwise(F.array(piece))
    return listed.withColumn("_piece", F.explode(pieces)).withColumn("_length", F.when(F.col("_kind") == "any", 0).otherwise(F.length("_piece")))


def _pieces(text: Column, kind: str, length: int) -> Column:
    """The pieces of a text that patterns of a kind and length are listed under."""
    if kind == "any":
        return F.array(F.pmod(F.xxhash64(text), F.lit(SPREAD)).cast("string"))
    if kind == "start":
        return F.array(F.left(text, F.lit(length)))
    if kind == "end":
        return F.array(F.right(text, F.lit(length)))
    places = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(length)))))


def _entries(text: Column, kind: str, length: int) -> Column:
    pieces = F.coalesce(_pieces(text, kind, length), F.array().cast("array<string>"))
    return F.transform(pieces, lambda piece: F.struct(F.lit(kind).alias("_kind"), F.lit(length).alias("_length"), piece.alias("_piece")))


def pattern_classes(
    rows: DataFrame, text: str, patterns: DataFrame, pattern: str, rank: str, label: str, name: str = "class", ignore_case: bool = False
) -> DataFrame:
    """``rows`` with the label of the first matching pattern by ``rank``; null where none matches or the text is null.

    Ties of rank go to the pattern that sorts first, then to its least label, null last.
    Null patterns match nothing.  Texts are compared once each, however often they occur.
    A pattern without any literal (such as ``%``) is compared with every text.
    """
    seen = rows.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    seen = seen.withColumn("_form", F.lower("_text") if ignore_case else F.col("_text"))
    form = F.lower(F.col(pattern)) if ignore_case else F.col(pattern)
    given = patterns.select(form.alias("_pattern"), F.col(rank).alias("_rank"), F.col(label).alias("_label")).filter(F.col("_pattern").isNotNull())
    index = staged(pattern_index(given, "_pattern"), "pattern-index")
    shapes = sorted((r._kind, r._length) for r in index.select("_kind", "_length").distinct().collect())  # at most 57
    if not shapes:
        return rows.withColumn(name, F.lit(None).cast(patterns.schema[label].dataType))
    own = F.flatten(F.array(*[_entries(F.col("_form"), kind, length) for kind, length in shapes]))
    met = seen.select("_text", "_form", F.inline(own)).join(index, ["_kind", "_length", "_piece"]).filter(F.expr("_form LIKE _pattern"))
    order = F.struct("_rank", "_pattern", F.col("_label").isNull(), F.col("_label"))
    first = met.groupBy("_text").agg(F.min(order)["_label"].alias(name))
    return null_safe_join(rows.drop(name), first.withColumnRenamed("_text", text), [text], "left")
