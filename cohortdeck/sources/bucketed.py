"""Tables dealt out once by a key, so that later joins and groupings on it move nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortdeck.session import scratch_path


def deal_out(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` in ``buckets`` files by the hash of ``key`` and read it from there.

    Tables meant to meet take the same number of buckets.  Rows of a key share a bucket, so
    reduce what a key can hold much of first.  The folder is under the shared scratch
    folder; the table's name in the session's catalog ends like it.
    """
    path = scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def meet_in_buckets(spark: SparkSession) -> None:
    """Let joins on the key and further columns use the buckets too, in all plans of the session from now on.

    Otherwise Spark deals both sides out anew by all columns of the join, which parts busy
    keys better; ``session.tune`` goes back to that.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def open_dealt(spark: SparkSession, path: str, table: str, columns: str, key: str, buckets: int) -> DataFrame:
    """Register a folder that another session dealt out; ``columns`` as in ``user_id bigint, ts timestamp``."""
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
