"""The driver's tables in the roles the jobs expect, for Spark and for SQL.

Customers are users (their GUID is a hash of the key), orders and lines are the
billing chain, events are the site's logs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortdeck.functions.extract import json_value
from cohortdeck.functions.labels import band, code_label
from cohortdeck.functions.numbers import money
from cohortdeck.functions.times import shift, us_week
from cohortdeck.sources.tables import parquet_table

# Declared, so that no job is spent on looking schemas up.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

AS_OF = "2024-01-31 00:00:00"
SEGMENT_CODES = {"BUILDING": 1, "AUTOMOBILE": 2, "MACHINERY": 3, "HOUSEHOLD": 4}

USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS handle, c_mktsegment AS segment, c_nationkey AS nation_key,
    upper(md5(CAST(c_custkey AS VARCHAR))) AS testing_guid,
    CASE WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal < 1000 THEN 1 ELSE 0 END AS login_disabled,
    TIMESTAMP '2023-12-20 12:00:00' + c_nationkey * INTERVAL 1 DAY AS signup_ts,
    DATE '1944-01-01' + CAST(floor((c_acctbal + 1000) * 2.5) AS INTEGER) AS birthday,
    CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3
      WHEN 'HOUSEHOLD' THEN 4 END AS seeking
  FROM customer)"""

LOG = """log AS (
  SELECT *, substring(site_code, 1, 2) || '1WEB' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS host,
    'Page ' || event_type || ' failed with k=' || CAST(k AS VARCHAR) AS message,
    CAST(user_id AS VARCHAR) || '-' || CAST((dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7 + 1 AS VARCHAR)
      AS session_id
  FROM (
    SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS amount,
      CAST(round(CAST(value AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS ms,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
      CASE WHEN value < 35 THEN 'DA' ELSE 'EC' END AS site_code
    FROM events))"""

TRX = """trx AS (
  SELECT o_orderkey AS trx_id, o_custkey AS user_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS priority,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status
  FROM orders)"""

RESIGNATIONS = """resignations AS (
  SELECT user_id, CASE WHEN k < 5 OR k BETWEEN 40 AND 44 THEN 'K' ELSE 'M' END AS resign_type, k AS resign_code,
    ts AS resign_ts
  FROM log WHERE event_type = 'error')"""

FRAUD = """fraud AS (
  SELECT DISTINCT u.user_id FROM users u JOIN resignations r ON r.user_id = u.user_id
  WHERE r.resign_type = 'K' AND r.resign_code NOT IN (42, 112, 1025)
    AND date_diff('second', date_trunc('second', u.signup_ts), date_trunc('second', r.resign_ts)) < 604800)"""

SALES = """sales AS (
  SELECT event_id AS sale_id, user_id, ts, day, amount FROM log WHERE event_type = 'purchase')"""


class Tables:
    """The input tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_SCHEMAS:
            raise AttributeError(name)
        table = parquet_table(self.spark, f"{self.sf_dir}/{name}.parquet", schema=TABLE_SCHEMAS[name])
        setattr(self, name, table)
        return table

    @cached_property
    def users(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self.customer.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("handle"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_key"),
            F.upper(F.md5(F.col("c_custkey").cast("string"))).alias("testing_guid"),
            F.when(balance < 0, 2).when(balance < 1000, 1).otherwise(0).alias("login_disabled"),
            shift("2023-12-20 12:00:00", F.col("c_nationkey"), "DAY").alias("signup_ts"),
            F.date_add(F.lit("1944-01-01").cast("date"), F.floor((balance + 1000) * 2.5).cast("int")).alias("birthday"),
            code_label(F.col("c_mktsegment"), SEGMENT_CODES).alias("seeking"),
        )

    @cached_property
    def log(self) -> DataFrame:
        k = json_value(F.col("props"), "$.k", "int")
        amount = money(F.col("value"))
        raw = self.events.select(
            "event_id",
            "ts",
            F.to_date("ts").alias("day"),
            "user_id",
            "event_type",
            amount.alias("amount"),
            F.round(amount * 100, 0).cast("bigint").alias("ms"),
            k.alias("k"),
            F.when(F.col("value") < 35, "DA").otherwise("EC").alias("site_code"),
        )
        return raw.select(
            "*",
            F.concat("site_code", F.lit("1WEB"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("host"),
            F.concat(F.lit("Page "), "event_type", F.lit(" failed with k="), F.col("k").cast("string")).alias("message"),
            F.concat_ws("-", "user_id", us_week(F.col("ts"))).alias("session_id"),
        )

    def log_of(self, *event_types: str) -> DataFrame:
        return self.log.filter(F.col("event_type").isin(*event_types))

    @property
    def trx(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("trx_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("ts"),
            money(F.col("o_totalprice")).alias("amount"),
            F.col("o_orderpriority").alias("priority"),
            code_label(F.col("o_orderstatus"), {"F": 1, "O": 2}, 3).alias("status"),
        )

    @property
    def resignations(self) -> DataFrame:
        fraud_like = (F.col("k") < 5) | F.col("k").between(40, 44)
        return self.log_of("error").select(
            "user_id",
            F.when(fraud_like, "K").otherwise("M").alias("resign_type"),
            F.col("k").alias("resign_code"),
            F.col("ts").alias("resign_ts"),
        )

    @property
    def sales(self) -> DataFrame:
        return self.log_of("purchase").select(F.col("event_id").alias("sale_id"), "user_id", "ts", "amount")

    @property
    def billing_chain(self) -> DataFrame:
        """Lines with their order and part."""
        lines = self.lineitem.select("l_orderkey", "l_partkey", money(F.col("l_extendedprice")).alias("amount"))
        return lines.join(self.orders, lines.l_orderkey == F.col("o_orderkey")).join(
            self.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
        )


def months_of(k):
    """Package length from the log's number."""
    return band(k, (24, 49, 74), ("1", "3", "6", "12")).cast("int")
