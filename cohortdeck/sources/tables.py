"""Table readers.  A source is a catalog table, a parquet path or a JDBC table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortdeck.functions.times import us_week
from cohortdeck.session import scratch_path


def catalog_table(spark: SparkSession, name: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """``catalog.database.table``; the catalogs of one query may differ."""
    return spark.table(name).select(*columns)


def parquet_table(
    spark: SparkSession, path: str, columns: Sequence[str] = ("*",), schema: StructType | str | None = None
) -> DataFrame:
    """A parquet table; a declared schema saves the job that looks it up."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).select(*columns)


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    splits: int,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """A remote table read in ``splits`` parallel ranges of a numeric column.

    Filters and column lists on the result are pushed into the remote query.  The
    driver jar and the credentials come with the session and ``options``.
    """
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=split_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(splits),
        fetchsize=str(fetch_size),
        **options,
    )
    return reader.load()


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register a temp view, so SQL text can use the frame by name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def query(spark: SparkSession, text: str, /, **parameters) -> DataFrame:
    """A parameterised SQL dataset: ``:name`` markers are bound, never spliced in."""
    return spark.sql(text, args=parameters)


def require_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Check an input against its contract and cast it; missing columns are an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_weekly(df: DataFrame, path: str, ts: str) -> None:
    """Store a log partitioned by year and week instead of one table per week.

    Rows of a week are brought together so that files are few, and a week that is too
    large for one task is split again by the adaptive planner.
    """
    (
        df.withColumn("log_year", F.year(ts))
        .withColumn("log_week", us_week(F.col(ts)))
        .hint("rebalance", "log_year", "log_week")
        .write.mode("overwrite")
        .partitionBy("log_year", "log_week")
        .parquet(path)
    )


def read_week(spark: SparkSession, path: str, year: int, week: int) -> DataFrame:
    """One week of such a log; only that week's folder is listed and read."""
    return spark.read.parquet(path).filter((F.col("log_year") == year) & (F.col("log_week") == week))


def _us_week_of(day: date) -> int:
    """``functions.times.us_week`` of a known day."""
    return (day.timetuple().tm_yday - 1 + (date(day.year, 1, 1).weekday() + 1) % 7) // 7 + 1


def read_between(spark: SparkSession, path: str, ts: str, start: datetime, end: datetime) -> DataFrame:
    """Rows of such a log with ``start <= ts < end``; only the weeks they fall in are listed and read."""
    last = end - timedelta(microseconds=1)
    folders = F.lit(False)
    for year in range(start.year, last.year + 1):
        first_day = max(start.date(), date(year, 1, 1))
        last_day = min(last.date(), date(year, 12, 31))
        weeks = F.col("log_week").between(_us_week_of(first_day), _us_week_of(last_day))
        folders = folders | ((F.col("log_year") == year) & weeks)
    return spark.read.parquet(path).filter(folders).filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate result in the shared scratch folder and read it from there.

    For a population several later steps start from: it is computed once, the plan is
    cut, and losing an executor costs nothing that was stored.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
