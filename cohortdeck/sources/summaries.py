"""Stored summaries: rewritten whole, read back with report names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck.sources.tables import require_columns


def write_summary(df: DataFrame, path: str, schema: StructType) -> None:
    """Replace a summary table; the declared schema fixes names, order and scales."""
    require_columns(df, schema).write.mode("overwrite").parquet(path)


def read_summary(spark: SparkSession, path: str, schema: StructType, names: dict[str, str] | None = None) -> DataFrame:
    """Read a summary with its declared schema; ``names`` maps stored to report names."""
    stored = spark.read.schema(schema).parquet(path)
    names = names or {}
    return stored.select(*[F.col(f.name).alias(names.get(f.name, f.name)) for f in schema])
