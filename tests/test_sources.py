"""Readers, summary tables, weekly logs and the scratch folder."""

from datetime import datetime

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortdeck import session
from cohortdeck.functions.times import us_week
from cohortdeck.sources import schemas, summaries, tables


def test_summary_is_replaced_whole_and_read_back(spark, tmp_path, rows):
    schema = schemas.conversion_funnel_schema()
    zeros = {f.name: F.lit(1).alias(f.name) for f in schema if f.name != "cohort"}
    for name in ("old", "new"):
        df = spark.createDataFrame([(name,)], "cohort string").select("cohort", *zeros.values())
        summaries.write_summary(df, str(tmp_path / "s"), schema)
    back = summaries.read_summary(spark, str(tmp_path / "s"), schema, {"cohort": "Cohort", "arpu": "ARPU"})
    assert rows(back, "Cohort", "ARPU") == [("new", Decimal("1.0000"))]
    assert [f.dataType for f in back.schema] == [f.dataType for f in schema]


def test_missing_summary_columns_are_an_error(spark, tmp_path):
    schema = schemas.conversion_funnel_schema({"segment": StringType()})
    with pytest.raises(ValueError, match="viewers"):
        summaries.write_summary(spark.createDataFrame([("a",)], "segment string"), str(tmp_path / "s"), schema)


def test_weekly_log_reads_one_folder(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d),) for d in range(1, 29)]
    path = str(tmp_path / "log")
    tables.write_weekly(spark.createDataFrame(rows, "ts timestamp_ntz"), path, "ts")
    week = tables.read_week(spark, path, 2024, 2)
    assert sorted(r.ts.day for r in week.collect()) == [7, 8, 9, 10, 11, 12, 13]
    assert all("log_week=2/" in f for f in week.inputFiles()) or "PartitionFilters: [isnotnull" in week._jdf.queryExecution().toString()


def test_bound_parameters_are_not_spliced(spark):
    tables.as_view(spark.range(5), "cohortdeck_numbers")
    found = tables.query(spark, "SELECT count(*) AS n FROM cohortdeck_numbers WHERE id >= :low AND :text = '1 OR 1=1'", low=2, text="1 OR 1=1")
    assert found.first().n == 3


def test_catalog_and_parquet_tables(spark, tmp_path):
    spark.range(3).withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / "p"))
    assert tables.parquet_table(spark, str(tmp_path / "p"), ["x"], "id bigint, x bigint").columns == ["x"]
    spark.range(2).createOrReplaceTempView("cohortdeck_two")
    assert tables.catalog_table(spark, "cohortdeck_two").count() == 2


class FakeSession:
    """Just enough of a session to ask for settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {"spark.sql.warehouse.dir": "file:/w/house", **settings}

    def get(self, name, *default):
        return self.settings.get(name, *default)


def test_scratch_folder_follows_the_settings():
    shared = FakeSession(**{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert session.scratch_path(shared, "x").startswith("hdfs:///shared/x-")
    assert session.scratch_path(shared, "x", "s3://other").startswith("s3://other/x-")
    assert session.scratch_path(FakeSession(), "x").startswith("file:/w/house/_scratch/x-")


def test_weeks_of_a_range(spark, tmp_path):
    """A range over new year reads the folders it needs and no others."""
    days = spark.sql("SELECT explode(sequence(timestamp_ntz'2022-11-20', timestamp_ntz'2024-02-10', interval 6 hours)) AS ts")
    tables.write_weekly(days, str(tmp_path / "log"), "ts")
    start, end = datetime(2022, 12, 28, 3), datetime(2023, 1, 5)
    found = tables.read_between(spark, str(tmp_path / "log"), "ts", start, end)
    want = days.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    assert sorted(r.ts for r in found.collect()) == sorted(r.ts for r in want.collect())
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "log_week" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    folders = {r.f for r in found.select(F.regexp_extract(F.input_file_name(), "log_year=.*log_week=[0-9]+", 0).alias("f")).distinct().collect()}
    assert folders == {"log_year=2022/log_week=53", "log_year=2023/log_week=1"}
    each = days.withColumn("w", us_week(F.col("ts"))).collect()
    assert all(tables._us_week_of(r.ts.date()) == r.w for r in each)


def test_staged_result_cuts_the_plan(spark, rows):
    df = spark.range(4).groupBy((F.col("id") > 1).alias("big")).count()
    kept = tables.staged(df, "groups")
    assert rows(kept) == rows(df)
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()


class FakeReader:
    """Records what a reader is asked for."""

    def __init__(self):
        self.read = self
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def load(self):
        return self.seen


def test_remote_tables_are_read_in_ranges():
    seen = tables.jdbc_table(FakeReader(), "jdbc:x://h/db", "dbo.trx", "trx_id", 0, 1000, 8, user="u")
    assert seen["format"] == "jdbc" and seen["dbtable"] == "dbo.trx" and seen["user"] == "u"
    assert (seen["partitionColumn"], seen["lowerBound"], seen["upperBound"], seen["numPartitions"]) == ("trx_id", "0", "1000", "8")
