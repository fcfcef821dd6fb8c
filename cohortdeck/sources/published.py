"""Stored results that change while others read them: versions, and a list of what is complete.

Data goes into a new folder each time, and only when it is whole a line about it is added to
the list of the table.  A reader takes the list first.  So a write that fails half-way, or
is still under way, is never seen, and readers of an older version keep their files.

The list has one row per write, which is the only thing read on the driver; ``compact``
shortens what has to be read of increments.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck.sources.tables import require_columns

LIST = "version bigint, folder string, fingerprint string, whole boolean, rows bigint"


class SchemaChanged(ValueError):
    """The stored version has other columns or types than the reader declares."""


def fingerprint(schema: StructType) -> str:
    """Of names and types in order; nullability doesn't count."""
    return hashlib.sha256(",".join(f"{f.name} {f.dataType.simpleString()}" for f in schema).encode()).hexdigest()


@dataclass
class Published:
    """A table at ``path`` with the declared ``schema``."""

    spark: SparkSession
    path: str
    schema: StructType

    def entries(self) -> list[Row]:
        """The list, oldest first; empty before the first write."""
        listed = f"{self.path}/list"
        try:
            rows = self.spark.read.schema(LIST).parquet(listed).collect()
        except Exception as error:  # a table nobody has written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted(rows, key=lambda r: (r["version"], r["whole"]))

    def latest(self) -> int | None:
        entries = self.entries()
        return entries[-1]["version"] if entries else None

    def publish(self, df: DataFrame, version: int | None = None, whole: bool = True) -> int:
        """Write a version and list it once it is complete; ``whole`` replaces all before, else it adds to them."""
        if version is None:
            version = (self.latest() or 0) + 1
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        require_columns(df, self.schema).write.parquet(folder)
        rows = self.spark.read.schema(self.schema).parquet(folder).count()
        line = self.spark.createDataFrame([(version, folder, fingerprint(self.schema), whole, rows)], LIST)
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/list")
        return version

    def read(self, version: int | None = None, names: dict[str, str] | None = None) -> DataFrame:
        """The newest state, or the state at ``version``; ``names`` maps stored to report names."""
        known = [e for e in self.entries() if version is None or e["version"] <= version]
        if not known or (version is not None and known[-1]["version"] != version):
            raise LookupError(f"{self.path} has no version {'yet' if version is None else version}")
        last_whole = max((k for k, e in enumerate(known) if e["whole"]), default=0)
        parts = known[last_whole:]
        if any(e["fingerprint"] != fingerprint(self.schema) for e in parts):
            raise SchemaChanged(f"{self.path} was written with another schema")
        names = names or {}
        stored = self.spark.read.schema(self.schema).parquet(*[e["folder"] for e in parts])
        return stored.select(*[F.col(f.name).alias(names.get(f.name, f.name)) for f in self.schema])


class Increments:
    """Counts per key that arrive in numbered batches and are kept as sums.

    A batch is summed once and stored; a batch whose number is listed is not stored again, so a
    repeated run changes nothing.  Rows that arrive late add to their key like any others.
    ``keys`` and their types come from the schema, whose last column is the count.
    """

    def __init__(self, table: Published):
        self.table = table
        *self.keys, self.value = table.schema.names

    def append(self, counts: DataFrame, batch: int) -> bool:
        """Store the sums of a batch; False if it is stored already."""
        if any(e["version"] == batch for e in self.table.entries()):
            return False
        summed = counts.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))
        self.table.publish(summed, batch, whole=False)
        return True

    def state(self) -> DataFrame:
        """The sums of all batches."""
        return self.table.read().groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))

    def batch(self, number: int) -> DataFrame:
        """The sums of one batch."""
        (entry,) = [e for e in self.table.entries() if e["version"] == number and not e["whole"]]
        return self.table.spark.read.schema(self.table.schema).parquet(entry["folder"])

    def compact(self) -> None:
        """Replace the parts by their sums, under the newest number."""
        newest = self.table.latest()
        if newest is not None:
            self.table.publish(self.state(), newest, whole=True)
