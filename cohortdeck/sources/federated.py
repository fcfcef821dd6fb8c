"""One logical table over several sources that name, type and limit its columns each in their own way."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck.functions.times import moment


@dataclass(frozen=True)
class Source:
    """A member table.

    ``read`` opens it (a parquet folder, a catalog or a JDBC table).  ``columns`` gives a
    logical column by the member's own name or by an expression; others have the same
    name in both, and what the member hasn't is null.  ``start`` and ``end`` say, where
    known, that all its times lie in ``[start, end)``.
    """

    name: str
    read: Callable[[SparkSession], DataFrame]
    columns: Mapping[str, str | Column] = field(default_factory=dict)
    start: datetime | None = None
    end: datetime | None = None

    def overlaps(self, start: datetime | None, end: datetime | None) -> bool:
        before = self.end is not None and start is not None and self.end <= start
        after = self.start is not None and end is not None and self.start >= end
        return not (before or after)


def federated_table(
    spark: SparkSession,
    sources: Sequence[Source],
    schema: StructType,
    ts: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    source_column: str = "source",
) -> DataFrame:
    """The rows of all ``sources`` in the types of ``schema``, with the name of their source.

    With ``ts`` only rows with ``start <= ts < end`` are read: members outside these bounds
    aren't opened, and where the logical time is a plain column of a member's, the bounds
    are set on that column, before renames and casts, so they reach its scan.  A filter
    on ``source_column`` leaves only the scans it names.  A repeated name is an error.
    """
    names = [s.name for s in sources]
    if len(set(names)) < len(names):
        raise ValueError("sources need names of their own")
    parts = []
    for source in sources:
        if ts is not None and not source.overlaps(start, end):
            continue
        frame = source.read(spark)
        given = {f.name: source.columns.get(f.name, f.name) for f in schema}
        if ts is not None:
            own = given[ts]
            time = F.col(own) if isinstance(own, str) else own
            frame = frame if start is None else frame.filter(time >= moment(start))
            frame = frame if end is None else frame.filter(time < moment(end))
        cells = []
        for f in schema:
            own = given[f.name]
            known = F.lit(None) if isinstance(own, str) and own not in frame.columns else F.col(own) if isinstance(own, str) else own
            cells.append(known.cast(f.dataType).alias(f.name))
        parts.append(frame.select(F.lit(source.name).alias(source_column), *cells))
    if not parts:
        empty = spark.createDataFrame([], schema)
        return empty.select(F.lit("").alias(source_column), *schema.names)
    return reduce(DataFrame.unionAll, parts)
