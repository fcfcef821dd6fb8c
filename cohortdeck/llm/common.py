"""What several operators share: table paths, staged tables and the ASCII white space of the contracts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import cohortdeck
from cohortdeck.session import scratch_path

# The white space words and lines are cut at.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_FILE = 100_000  # narrow rows that are worth a task and a file of their own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it from there.

    Several steps then start from it, its lineage is cut, and an executor that is lost
    takes nothing with it.  Where it has at most ``rows`` narrow rows, it goes to as many
    files as these need (all cores at least) instead of one per shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context, as they may not have it on their path.

    Spark itself hands the archive from the driver to every executor.
    """
    context = spark.sparkContext
    root = Path(cohortdeck.__file__).parent
    if getattr(context, "_cohortdeck_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="cohortdeck-")) / "cohortdeck.zip"
    with zipfile.ZipFile(archive, "w") as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._cohortdeck_shipped = True


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
