"""Checks of the single operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from cohortdeck import fixed_values as fixed
from cohortdeck.checks.entities import LOG, USERS, Tables
from cohortdeck.checks.registry import check, sql_rate
from cohortdeck.functions import extract, labels, numbers, texts, times
from cohortdeck.operators import actives, aggregates, asof, calendars, filters, joins, patterns, reduction, selection, sets, timeline
from cohortdeck.operators.baselines import group_spread
from cohortdeck.plans import messaging, monitoring
from cohortdeck.plans.funnels import first_views
from cohortdeck.session import scratch_path
from cohortdeck.sources import federated, published, summaries, tables

# --- sources -------------------------------------------------------------------


@check(
    "parameterised_query",
    """SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00'
    GROUP BY event_type HAVING count(*) > 20""",
)
def parameterised_query(t: Tables) -> DataFrame:
    tables.as_view(t.events, "cohortdeck_events")
    text = """SELECT event_type, count(*) AS n FROM cohortdeck_events
              WHERE ts >= CAST(:start AS TIMESTAMP_NTZ) GROUP BY event_type HAVING count(*) > :least"""
    return tables.query(t.spark, text, start="2024-01-03", least=20)


@check(
    "two_source_join",
    """SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def two_source_join(t: Tables) -> DataFrame:
    tables.as_view(t.orders, "cohortdeck_orders")
    remote = tables.catalog_table(t.spark, "cohortdeck_orders", ["o_custkey"])
    counts = remote.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        counts.join(t.customer, ["c_custkey"])
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.sum("_n").alias("orders"))
    )


@check(
    "weekly_partition_scan",
    """SELECT event_type, count(*) AS n FROM events
    WHERE year(ts) = 2024 AND (dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7 + 1 = 3
    GROUP BY event_type""",
)
def weekly_partition_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "weekly-log")
    tables.write_weekly(t.events, path, "ts")
    return tables.read_week(t.spark, path, 2024, 3).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "weekly_range_scan",
    """SELECT event_type, count(*) AS n FROM (SELECT event_type, ts - INTERVAL 20 DAY AS ts FROM events)
    WHERE ts >= TIMESTAMP '2023-12-27 06:30:00' AND ts < TIMESTAMP '2024-01-04' GROUP BY event_type""",
)
def weekly_range_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "weekly-log")
    tables.write_weekly(t.events.withColumn("ts", times.shift(F.col("ts"), -20, "DAY")), path, "ts")
    found = tables.read_between(t.spark, path, "ts", datetime(2023, 12, 27, 6, 30), datetime(2024, 1, 4))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "federated_scan",
    """WITH a AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'old' WHEN ts < TIMESTAMP '2024-01-20' THEN 'middle' ELSE 'new' END AS source,
        CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN NULL ELSE event_type END AS event_type, value FROM events
      WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-25')
    SELECT source, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM a WHERE source <> 'none' GROUP BY 1, 2""",
)
def federated_scan(t: Tables) -> DataFrame:
    """Three folders of one log that name their columns differently, one without the kind of event."""
    days = [datetime(2024, 1, 1), datetime(2024, 1, 10), datetime(2024, 1, 20), datetime(2024, 3, 1)]
    own = {
        "old": {"ts": "happened", "event_type": "kind", "amount": F.col("cents") / 100},
        "middle": {"amount": "amount"},
        "new": {"ts": "ts", "amount": "value"},
    }
    shapes = {
        "old": [F.col("ts").alias("happened"), F.col("event_type").alias("kind"), F.round(F.col("value").cast("decimal(18,2)") * 100).cast("bigint").alias("cents")],
        "middle": [F.col("ts"), F.col("value").cast("decimal(18,2)").cast("string").alias("amount")],
        "new": [F.col("ts"), F.col("event_type"), F.col("value")],
    }
    members = []
    for name, start, end in zip(own, days, days[1:]):
        path = scratch_path(t.spark, f"log-{name}")
        bounds = (None if name == "old" else start, None if name == "new" else end)
        filters.between_moments(t.events, "ts", *bounds).select(*shapes[name]).write.parquet(path)
        members.append(federated.Source(name, lambda spark, path=path: spark.read.parquet(path), own[name], *bounds))
    schema = StructType().add("ts", "timestamp_ntz").add("event_type", "string").add("amount", "decimal(18,2)")
    log = federated.federated_table(t.spark, members, schema, "ts", datetime(2024, 1, 5, 6), datetime(2024, 1, 25))
    return log.groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@check(
    "summary_sink_roundtrip",
    """SELECT c_mktsegment AS "Segment", count(*) AS "Users",
      CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS "Total Cash" FROM customer GROUP BY c_mktsegment""",
)
def summary_sink_roundtrip(t: Tables) -> DataFrame:
    schema = StructType(
        [
            StructField("segment", StringType()),
            StructField("users", LongType()),
            StructField("total_cash", DecimalType(18, 4)),
        ]
    )
    summary = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("users"), F.sum(numbers.money(F.col("c_acctbal"))).alias("total_cash")
    )
    path = scratch_path(t.spark, "summary")
    summaries.write_summary(summary, path, schema)
    names = {"segment": "Segment", "users": "Users", "total_cash": "Total Cash"}
    return summaries.read_summary(t.spark, path, schema, names)


@check(
    "published_summary",
    """SELECT c_mktsegment AS segment, count(*) AS users, count(*) FILTER (c_acctbal >= 0) AS before FROM customer GROUP BY c_mktsegment""",
)
def published_summary(t: Tables) -> DataFrame:
    """The newest version of a summary beside the one before it, which stays readable."""
    schema = StructType([StructField("segment", StringType()), StructField("users", LongType())])
    table = published.Published(t.spark, scratch_path(t.spark, "published"), schema)
    everyone = t.customer.select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    for rows in (everyone.filter(F.col("c_acctbal") >= 0), everyone):
        table.publish(rows.groupBy("segment").agg(F.count(F.lit(1)).alias("users")))
    old = table.read(1, {"users": "before"})
    return table.read().join(old, "segment", "left").fillna(0, ["before"])


@check(
    "staged_result",
    """WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT 'busy' AS side, count(*) AS users FROM s WHERE n >= 65
    UNION ALL SELECT 'quiet', count(*) FROM s WHERE n < 65""",
)
def staged_result(t: Tables) -> DataFrame:
    per_user = tables.staged(t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "per-user")
    parts = [
        per_user.filter(test).agg(F.count(F.lit(1)).alias("users")).select(F.lit(side).alias("side"), "users")
        for side, test in (("busy", F.col("n") >= 65), ("quiet", F.col("n") < 65))
    ]
    return sets.append(*parts)


# --- filters -------------------------------------------------------------------


@check(
    "filter_patterns",
    """SELECT p_brand, count(*) AS n FROM part
    WHERE (p_name LIKE 'red%' OR p_name LIKE '%bolt' OR p_name LIKE '%l g%')
      AND p_name NOT LIKE 'old%' AND p_name NOT LIKE 'sm_ll r%' AND p_name <> 'blue gear' GROUP BY p_brand""",
)
def filter_patterns(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return (
        t.part.filter(texts.matches_any(name, ["red%", "%bolt", "%l g%"]))
        .filter(texts.matches_none(name, ["old%", "sm_ll r%"], ["blue gear"]))
        .groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@check(
    "closed_day_window",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1""",
)
def closed_day_window(t: Tables) -> DataFrame:
    rows = filters.closed_days(t.events, "ts", "2024-01-30 08:00:00", 28)
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "rolling_window",
    """SELECT event_type, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-30 08:00:00' - INTERVAL 25 DAY GROUP BY event_type""",
)
def rolling_window(t: Tables) -> DataFrame:
    rows = filters.rolling_window(t.events, "ts", "2024-01-30 08:00:00", 25, "DAY")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "lagged_window",
    """SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 08:00:00' - INTERVAL 30000 MINUTE
      AND ts < TIMESTAMP '2024-01-30 08:00:00' - INTERVAL 75 MINUTE GROUP BY event_type""",
)
def lagged_window(t: Tables) -> DataFrame:
    rows = filters.lagged_window(t.events, "ts", "2024-01-30 08:00:00", 30000, 75)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "weekday_filter",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, dayname(ts) AS weekday, hour(ts) AS hour, count(*) AS n
    FROM events WHERE dayname(ts) NOT IN ('Saturday', 'Sunday') GROUP BY 1, 2, 3""",
)
def weekday_filter(t: Tables) -> DataFrame:
    return (
        filters.on_weekdays(t.events, "ts")
        .groupBy(F.to_date("ts").alias("day"), times.weekday_name(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@check(
    "null_predicates",
    """WITH x AS (SELECT nullif(event_type, 'error') AS kind, CASE WHEN value < 20 THEN '  ' ELSE event_type END AS text
      FROM events)
    SELECT coalesce(kind, 'none') AS kind, sum(CASE WHEN kind <> 'view' OR kind IS NULL THEN 1 ELSE 0 END)::BIGINT AS not_view,
      sum(CASE WHEN length(rtrim(coalesce(nullif(text, 'click'), ''))) = 0 THEN 1 ELSE 0 END)::BIGINT AS blank,
      count(kind) AS known
    FROM x GROUP BY 1""",
)
def null_predicates(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.nullif(F.col("event_type"), F.lit("error")).alias("kind"),
        F.when(F.col("value") < 20, "  ").otherwise(F.col("event_type")).alias("text"),
    )
    return rows.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(
        aggregates.count_when(filters.differs_or_null(F.col("kind"), "view")).alias("not_view"),
        aggregates.count_when(texts.is_blank(F.nullif(F.col("text"), F.lit("click")))).alias("blank"),
        F.count("kind").alias("known"),
    )


@check(
    "column_predicates",
    """SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem WHERE l_quantity <> l_linenumber AND l_discount / nullif(l_tax, 0) >= 0.75
      AND l_quantity BETWEEN 10 AND 40 AND l_linestatus NOT IN ('O') GROUP BY 1""",
)
def column_predicates(t: Tables) -> DataFrame:
    ratio = numbers.nullable_rate(F.col("l_discount"), F.col("l_tax"))
    return (
        t.lineitem.filter(F.col("l_quantity") != F.col("l_linenumber"))
        .filter((ratio >= 0.75) & F.col("l_quantity").between(10, 40) & ~F.col("l_linestatus").isin("O"))
        .groupBy(F.col("l_returnflag").alias("flag"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@check("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type").distinct()


@check(
    "union_append",
    """SELECT user_id, source, count(*) AS n FROM (
      SELECT user_id, 'event' AS source FROM events UNION ALL SELECT o_custkey, 'order' FROM orders) GROUP BY 1, 2""",
)
def union_append(t: Tables) -> DataFrame:
    events = t.events.select("user_id", F.lit("event").alias("source"))
    orders = t.orders.select(F.col("o_custkey").alias("user_id"), F.lit("order").alias("source"))
    return sets.append(events, orders).groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("n"))


# --- joins ----------------------------------------------------------------------


@check(
    "snowflake_join",
    """SELECT r_name AS region, l_returnflag AS flag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def snowflake_join(t: Tables) -> DataFrame:
    # lines are summed before every further lookup, so a busy customer is one row
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag")).agg(
        F.sum(numbers.money(F.col("l_extendedprice"))).alias("revenue")
    )
    per_customer = (
        lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), ["o_orderkey"])
        .groupBy("c_custkey", "flag")
        .agg(F.sum("revenue").alias("revenue"))
    )
    per_nation = (
        per_customer.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
        .groupBy("n_nationkey", "flag")
        .agg(F.sum("revenue").alias("revenue"))
    )
    named = per_nation.join(t.nation, ["n_nationkey"]).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy(F.col("r_name").alias("region"), "flag").agg(F.sum("revenue").alias("revenue"))


@check(
    "role_joins",
    """SELECT cn.n_name AS buyer_nation, sn.n_name AS seller_nation, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""",
)
def role_joins(t: Tables) -> DataFrame:
    per_order = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = joins.with_role(per_order, "l_orderkey", t.orders, "o_orderkey", {"o_custkey": "o_custkey"})
    pairs = orders.groupBy("o_custkey", "l_suppkey").agg(F.sum("lines").alias("lines"))
    buyers = joins.with_role(pairs, "o_custkey", t.customer, "c_custkey", {"c_nationkey": "buyer"})
    sellers = joins.with_role(
        buyers.groupBy("buyer", "l_suppkey").agg(F.sum("lines").alias("lines")),
        "l_suppkey",
        t.supplier,
        "s_suppkey",
        {"s_nationkey": "seller"},
    )
    nations = sellers.groupBy("buyer", "seller").agg(F.sum("lines").alias("lines"))
    named = joins.with_role(nations, "buyer", t.nation, "n_nationkey", {"n_name": "buyer_nation"})
    named = joins.with_role(named, "seller", t.nation, "n_nationkey", {"n_name": "seller_nation"})
    return named.select("buyer_nation", "seller_nation", "lines")


@check(
    "left_join_on_filter",
    """SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS users, count(DISTINCT o_custkey) AS buyers,
      count(o_orderkey) AS orders
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000
    GROUP BY 1""",
)
def left_join_on_filter(t: Tables) -> DataFrame:
    bought = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).groupBy(
        F.col("o_custkey").alias("c_custkey")
    ).agg(F.count(F.lit(1)).alias("_orders"))
    joined = joins.optional_join(t.customer, bought, ["c_custkey"], F.col("_orders") > 0)
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("c_custkey").alias("users"),
        F.count("_orders").alias("buyers"),
        F.coalesce(F.sum("_orders"), F.lit(0)).alias("orders"),
    )


@check(
    "anti_join",
    """SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN
      (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') x ON o_custkey = c_custkey
    WHERE o_custkey IS NULL""",
)
def anti_join(t: Tables) -> DataFrame:
    pending = t.orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
    return joins.without_keys(
        t.customer, pending.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]
    ).select("c_custkey", "c_mktsegment")


@check(
    "null_aware_anti",
    """WITH seen AS (SELECT user_id FROM events WHERE event_type = 'purchase'),
      holed AS (SELECT user_id FROM seen UNION ALL SELECT CAST(NULL AS BIGINT)),
      nobody AS (SELECT user_id FROM events WHERE event_type = 'absent'),
      asked AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END AS user_id FROM customer)
    SELECT 'seen' AS variant, count(*) AS n FROM asked WHERE user_id NOT IN (SELECT user_id FROM seen)
    UNION ALL SELECT 'holed', count(*) FROM asked WHERE user_id NOT IN (SELECT user_id FROM holed)
    UNION ALL SELECT 'nobody', count(*) FROM asked WHERE user_id NOT IN (SELECT user_id FROM nobody)""",
)
def null_aware_anti(t: Tables) -> DataFrame:
    asked = t.customer.select(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("user_id"))
    seen = t.events.filter(F.col("event_type") == "purchase").select("user_id")
    holed = sets.append(seen, t.spark.range(1).select(F.lit(None).cast("bigint").alias("user_id")))
    nobody = t.events.filter(F.col("event_type") == "absent").select("user_id")
    parts = [
        joins.not_in(asked, "user_id", other, "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("variant"), "n")
        for name, other in (("seen", seen), ("holed", holed), ("nobody", nobody))
    ]
    return sets.append(*parts)


@check(
    "semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE value > 150)",
)
def semi_join(t: Tables) -> DataFrame:
    high = t.events.filter(F.col("value") > 150).select(F.col("user_id").alias("c_custkey"))
    return joins.with_keys(t.customer, high, ["c_custkey"]).select("c_custkey", "c_name")


SELECTED = "segment = 'BUILDING' AND login_disabled = 0 AND nation_key < 5"


@check(
    "reduced_semi_join",
    f"""WITH {USERS} SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events
    WHERE user_id IN (SELECT user_id FROM users WHERE {SELECTED}) GROUP BY 1""",
)
def reduced_semi_join(t: Tables) -> DataFrame:
    """The log of a small population; other rows are dropped while it is scanned."""
    found = reduction.reduced_semi_join(t.events, t.users.filter(SELECTED), ["user_id"])
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@check(
    "reduced_anti_join",
    f"""WITH {USERS} SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events e
    WHERE NOT EXISTS (FROM users u WHERE u.user_id = e.user_id AND {SELECTED}) GROUP BY 1""",
)
def reduced_anti_join(t: Tables) -> DataFrame:
    """The log without a small population; only rows that may be theirs are moved."""
    found = reduction.reduced_anti_join(t.events, t.users.filter(SELECTED), ["user_id"])
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


# Patterns made of the users: whole ends, beginnings with one-letter wildcards, runs inside, and what is left.
PATTERNS = r"""patterns AS (
  SELECT '%WEB' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS pattern, 1 AS rank, 'user of ' || segment AS label FROM users WHERE user_id % 3 = 0
  UNION ALL SELECT 'DA1WEB' || substring(lpad(CAST(user_id AS VARCHAR), 6, '0'), 1, 5) || '_', 2, 'ten at DA' FROM users WHERE user_id % 20 = 1
  UNION ALL SELECT '%1WEB' || substring(lpad(CAST(user_id AS VARCHAR), 6, '0'), 1, 5) || '%', 3, 'ten anywhere' FROM users WHERE user_id % 20 = 11
  UNION ALL SELECT 'EC%', 4, 'EC'
  UNION ALL SELECT '____________', 5, 'twelve letters')"""


@check(
    "pattern_classes",
    f"""WITH {USERS}, {LOG}, {PATTERNS}, h AS (SELECT host, count(*) AS n FROM log GROUP BY 1),
    c AS (SELECT host, n, (SELECT min_by(label, rank) FROM patterns WHERE host LIKE pattern) AS class FROM h)
    SELECT class, count(*) AS hosts, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
)
def pattern_classes(t: Tables) -> DataFrame:
    """Hosts by the first of some thousand patterns."""
    digits, five = F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lpad(F.col("user_id").cast("string"), 6, "0").substr(1, 5)
    column = F.col("user_id")
    listed = [
        t.users.filter(column % 3 == 0).select(F.concat(F.lit("%WEB"), digits), F.lit(1), F.concat(F.lit("user of "), "segment")),
        t.users.filter(column % 20 == 1).select(F.concat(F.lit("DA1WEB"), five, F.lit("_")), F.lit(2), F.lit("ten at DA")),
        t.users.filter(column % 20 == 11).select(F.concat(F.lit("%1WEB"), five, F.lit("%")), F.lit(3), F.lit("ten anywhere")),
        t.spark.createDataFrame([("EC%", 4, "EC"), ("_" * 12, 5, "twelve letters")], "pattern string, rank int, label string"),
    ]
    given = sets.append(*[frame.toDF("pattern", "rank", "label") for frame in listed])
    hosts = t.log.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    found = patterns.pattern_classes(hosts, "host", given, "pattern", "rank", "label")
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"))


@check(
    "event_before_event",
    f"""WITH {LOG} SELECT DISTINCT p.event_id, p.user_id, p.session_id FROM log p
    JOIN log c ON c.user_id = p.user_id AND c.session_id = p.session_id AND c.event_type = 'click' AND c.ts < p.ts
    WHERE p.event_type = 'purchase'""",
)
def event_before_event(t: Tables) -> DataFrame:
    found = joins.preceded_by(t.log_of("purchase"), "ts", t.log_of("click"), "ts", ["user_id", "session_id"])
    return found.select("event_id", "user_id", "session_id")


@check(
    "point_in_interval",
    """WITH views AS (SELECT user_id, ts FROM events WHERE event_type = 'view')
    SELECT s.event_id AS sale_id, count(v.ts) AS views FROM events s
    LEFT JOIN views v ON v.user_id = s.user_id AND v.ts BETWEEN s.ts AND s.ts + INTERVAL 60 HOUR
    WHERE s.event_type = 'purchase' GROUP BY 1""",
)
def point_in_interval(t: Tables) -> DataFrame:
    views = t.log_of("view").select("user_id", "ts")
    return timeline.interval_counts(
        t.sales, ["sale_id"], F.col("ts"), times.shift(F.col("ts"), 60, "HOUR"), views, "ts", ["user_id"], "views"
    )


@check(
    "interval_money",
    """WITH m AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS cents
      FROM events WHERE event_type IN ('error', 'purchase'))
    SELECT s.event_id AS sale_id, CAST(coalesce(sum(m.cents), 0) AS DOUBLE) / 100 AS balance FROM events s
    LEFT JOIN m ON m.user_id = s.user_id AND m.ts BETWEEN s.ts AND s.ts + INTERVAL 100 HOUR
    WHERE s.event_type = 'purchase' GROUP BY 1""",
)
def interval_money(t: Tables) -> DataFrame:
    """Purchases less refunds within 100 hours of each purchase; balances may be negative."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    moves = t.events.filter(F.col("event_type").isin("error", "purchase")).select(
        "user_id", "ts", F.when(F.col("event_type") == "error", -cents).otherwise(cents).alias("cents")
    )
    end = times.shift(F.col("ts"), 100, "HOUR")
    sums = timeline.interval_sums(t.sales, ["sale_id"], F.col("ts"), end, moves, "ts", ["user_id"], {"cents": F.col("cents")})
    return sums.select("sale_id", (F.col("cents").cast("double") / 100).alias("balance"))


@check(
    "top_half_by_time",
    """WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, ts) AS n,
      count(*) OVER (PARTITION BY event_type) AS size FROM (SELECT DISTINCT ON (event_type, user_id, ts) * FROM events ORDER BY event_id))
    SELECT event_id FROM r WHERE n <= (size + 1) // 2""",
)
def top_half_by_time(t: Tables) -> DataFrame:
    once = t.events.groupBy("event_type", "user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return selection.top_half(once, ["event_type"], "user_id", "ts").select("event_id")


@check(
    "package_lengths",
    """SELECT CASE WHEN l_quantity * 7 <= 30 THEN 1 WHEN l_quantity * 7 <= 100 THEN 3 WHEN l_quantity * 7 <= 200 THEN 6 ELSE 12 END::BIGINT AS months,
      count(*) AS n FROM lineitem GROUP BY 1""",
)
def package_lengths(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(labels.package_months(F.col("l_quantity") * 7).alias("months")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "validity_join",
    """SELECT p.event_id, CASE WHEN count(v.ts) > 0 THEN 'Sub' ELSE 'Non-Sub' END AS state, count(v.ts) AS held
    FROM events p LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') v
      ON v.user_id = p.user_id AND v.ts <= p.ts AND v.ts + INTERVAL 3 DAY > p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
)
def validity_join(t: Tables) -> DataFrame:
    valid = t.log_of("signup").select(
        "user_id", F.col("ts").alias("begin_ts"), times.shift(F.col("ts"), 3, "DAY").alias("end_ts")
    )
    points = t.log_of("purchase").select("event_id", "user_id", "ts")
    held = timeline.covering_count(points, "ts", valid, "begin_ts", "end_ts", ["user_id"], "held")
    state = F.when(F.col("held") > 0, "Sub").otherwise("Non-Sub")
    return held.select("event_id", state.alias("state"), "held")


@check(
    "asof_attributes",
    """WITH h AS (SELECT user_id, ts, max(struct_pack(k := CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER), u := ts + INTERVAL 4 DAY)) AS held
      FROM events WHERE event_type IN ('click', 'signup') GROUP BY user_id, ts),
      j AS (SELECT p.event_id, p.ts, CASE WHEN h.held.u > p.ts THEN h.held.k END AS k FROM events p ASOF LEFT JOIN h ON h.user_id = p.user_id AND h.ts <= p.ts)
    SELECT event_id, k IS NOT NULL AS found, k AS held_k FROM j""",
)
def asof_attributes(t: Tables) -> DataFrame:
    """What the user's latest click or signup said, unless it is four days old, for every event."""
    held = t.log_of("click", "signup").select(
        "user_id", F.col("ts").alias("since"), F.col("k").alias("held_k"), times.shift(F.col("ts"), 4, "DAY").alias("until")
    )
    points = t.events.select("event_id", "user_id", "ts")
    found = asof.asof_attributes(points, "ts", held, "since", ["user_id"], ["held_k"], "until")
    return found.select("event_id", "found", "held_k")


@check(
    "interval_pairs",
    """SELECT p.event_id, v.event_id AS offer_id FROM events p JOIN events v ON v.user_id = p.user_id AND p.ts >= v.ts
      AND p.ts <= CASE WHEN v.value < 30 THEN v.ts + INTERVAL 36 HOUR ELSE v.ts + INTERVAL 5 DAY END
    WHERE p.event_type IN ('purchase', 'click') AND v.event_type = 'view'""",
)
def interval_pairs(t: Tables) -> DataFrame:
    """Every purchase or click and every offer it falls into; offers run for a time that depends on their price."""
    offers = t.events.filter(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("offer_id"), F.col("ts").alias("begin_ts"), "value")
    end = F.when(F.col("value") < 30, times.shift(F.col("begin_ts"), 36, "HOUR")).otherwise(times.shift(F.col("begin_ts"), 5, "DAY"))
    points = t.events.filter(F.col("event_type").isin("purchase", "click")).select("event_id", "user_id", "ts")
    return asof.interval_pairs(points, "ts", offers, F.col("begin_ts"), end, ["user_id"]).select("event_id", "offer_id")


@check(
    "within_minutes",
    """SELECT p.event_id, count(c.ts) AS clicks FROM events p LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c
      ON c.user_id = p.user_id AND c.ts >= p.ts - INTERVAL 900 MINUTE AND c.ts < p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
)
def within_minutes(t: Tables) -> DataFrame:
    clicks = t.log_of("click").select("user_id", "ts")
    return timeline.interval_counts(
        t.log_of("purchase").select("event_id", "user_id", "ts"),
        ["event_id"],
        times.shift(F.col("ts"), -900, "MINUTE"),
        F.col("ts"),
        clicks,
        "ts",
        ["user_id"],
        "clicks",
        end_closed=False,
    )


@check(
    "bound_by_case",
    f"""WITH {USERS} SELECT e.user_id, strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS first_view
    FROM events e JOIN users u ON u.user_id = e.user_id
      AND e.ts > CASE WHEN u.login_disabled = 0 THEN u.signup_ts WHEN u.login_disabled = 1 THEN u.signup_ts + INTERVAL 1 DAY END
    WHERE e.event_type = 'view' GROUP BY e.user_id""",
)
def bound_by_case(t: Tables) -> DataFrame:
    users = t.users.select("user_id", "login_disabled", "signup_ts")
    bound = F.when(F.col("login_disabled") == 0, F.col("signup_ts")).when(
        F.col("login_disabled") == 1, times.shift(F.col("signup_ts"), 1, "DAY")
    )
    views = t.events.filter(F.col("event_type") == "view").select("user_id", "ts")
    return first_views(views, "user_id", "ts", users, bound).withColumnRenamed("ts", "first_view")


@check(
    "first_event_join",
    """WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY user_id)
    SELECT e.event_type, count(*) AS n FROM events e JOIN f ON f.user_id = e.user_id AND f.day = CAST(e.ts AS DATE) GROUP BY 1""",
)
def first_event_join(t: Tables) -> DataFrame:
    days = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    return joins.at_first_event(days, ["user_id"], "day").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "salted_join",
    """SELECT c_mktsegment AS segment, event_type, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1, 2""",
)
def salted_join(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    joined = joins.salted_join(t.events.select("event_id", "user_id", "event_type"), users, ["user_id"], 4, "left")
    return joined.groupBy("segment", "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates -------------------------------------------------------------------


@check(
    "conditional_counts",
    """SELECT user_id, count(*) AS n, sum(CASE WHEN value > 150 THEN 1 END)::BIGINT AS high_or_null,
      sum(CASE WHEN value > 150 THEN 1 ELSE 0 END)::BIGINT AS high, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS any_error
    FROM events GROUP BY user_id""",
)
def conditional_counts(t: Tables) -> DataFrame:
    high = F.col("value") > 150
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        aggregates.count_when_or_null(high).alias("high_or_null"),
        aggregates.count_when(high).alias("high"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("any_error"),
    )


@check(
    "conditional_distincts",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS users,
      count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers,
      count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers,
      count(DISTINCT CASE WHEN event_type = 'purchase' AND value > 100 THEN user_id END) AS big_buyers
    FROM events GROUP BY 1""",
)
def conditional_distincts(t: Tables) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    days = t.events.withColumn("day", F.to_date("ts"))
    return aggregates.distinct_flag_counts(
        days,
        ["day"],
        "user_id",
        "users",
        {"viewers": F.col("event_type") == "view", "buyers": bought, "big_buyers": bought & (F.col("value") > 100)},
    )


@check(
    "sum_squares",
    """SELECT l_returnflag AS flag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
      CAST(sum(CAST(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_quantity AS DECIMAL(9,2)) AS DECIMAL(38,4))) AS DOUBLE) AS squares
    FROM lineitem GROUP BY 1""",
)
def sum_squares(t: Tables) -> DataFrame:
    quantity = numbers.money(F.col("l_quantity"), 9)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.sum(numbers.money(F.col("l_extendedprice"))).alias("total"), F.sum(quantity * quantity).alias("squares")
    )


@check(
    "stdev_median",
    """WITH x AS (SELECT l_suppkey, CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS cents,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(round(l_extendedprice * 100, 0) AS BIGINT)) AS up,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(round(l_extendedprice * 100, 0) AS BIGINT) DESC) AS down,
        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, round(stddev_samp(CAST(cents AS DOUBLE)), 2) AS deviation, sum(cents)::BIGINT // count(*) AS average,
      (max(CASE WHEN up <= (n + 1) // 2 THEN cents END) + min(CASE WHEN down <= (n + 1) // 2 THEN cents END)) // 2 AS median
    FROM x GROUP BY l_suppkey""",
)
def stdev_median(t: Tables) -> DataFrame:
    cents = t.lineitem.select("l_suppkey", F.round(F.col("l_extendedprice") * 100, 0).cast("bigint").alias("cents"))
    spread = group_spread(cents, ["l_suppkey"], "cents")
    return spread.select("l_suppkey", F.round("deviation", 2).alias("deviation"), "average", "median")


@check(
    "first_date_counts",
    """SELECT CAST(day AS VARCHAR) AS first_day, count(user_id) AS new_users FROM (
      SELECT o_custkey AS user_id, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1) GROUP BY 1""",
)
def first_date_counts(t: Tables) -> DataFrame:
    return aggregates.first_date_counts(t.orders, "o_custkey", F.to_date("o_orderdate"), "first_day", "new_users")


@check(
    "last_status",
    f"""WITH {LOG} SELECT session_id, k AS to_user, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 0 END)::BIGINT
      AS last_status, CAST(day AS VARCHAR) AS metric_date, user_id AS from_user
    FROM log WHERE event_type <> 'purchase' GROUP BY day, session_id, user_id, k""",
)
def last_status(t: Tables) -> DataFrame:
    return messaging.last_status(alerts(t), "session_id")


def alerts(t: Tables) -> DataFrame:
    """Events as message alerts: the sender is the user, the recipient the log's number."""
    codes = {"signup": 0, "view": 1, "click": 2, "error": 3, "purchase": 5}
    return t.log.select(
        "session_id",
        F.col("user_id").alias("from_user"),
        F.col("k").cast("bigint").alias("to_user"),
        labels.code_label(F.col("event_type"), codes).alias("status"),
        "ts",
    )


@check(
    "percent_of_total",
    """SELECT event_type, count(*) AS n, CAST(CAST(round(count(*) * 10000.0 / (SELECT count(*) FROM events), 0) AS BIGINT) AS DOUBLE) / 100 AS percent
    FROM events GROUP BY event_type""",
)
def percent_of_total(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.percent_of_total(counts, "n", "percent")


@check(
    "dataset_totals",
    """SELECT count(*) AS orders, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS filled FROM orders""",
)
def dataset_totals(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("filled")
    )
    return aggregates.dataset_totals(daily, ["orders", "filled"])


@check(
    "pivot_counts",
    """SELECT user_id, sum(CASE WHEN event_type = 'view' THEN n END)::BIGINT AS views,
      coalesce(sum(CASE WHEN event_type = 'purchase' THEN n END), 0)::BIGINT AS purchases
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def pivot_counts(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.pivot_sum(counts, ["user_id"], "event_type", {"view": "views", "purchase": "purchases"}, F.col("n")).withColumn(
        "purchases", F.coalesce("purchases", F.lit(0))
    )


@check(
    "safe_rates",
    f"""WITH c AS (SELECT user_id, count(CASE WHEN value > 100 THEN 1 END) AS high, count(CASE WHEN value > 200 THEN 1 END) AS top FROM events GROUP BY 1)
    SELECT user_id, {sql_rate("top", "high", 4, "0.0")} AS safe, {sql_rate("top", "high", 3)} AS nullable FROM c""",
)
def safe_rates(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id").agg(
        F.count_if(F.col("value") > 100).alias("high"), F.count_if(F.col("value") > 200).alias("top")
    )
    top, high = F.col("top"), F.col("high")
    return counts.select(
        "user_id",
        numbers.safe_rate(top, high).alias("safe"),
        numbers.nullable_rate(top.cast("decimal(18,2)"), high).cast("decimal(10,3)").alias("nullable"),
    )


# --- order -------------------------------------------------------------------------


@check("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_n(t: Tables) -> DataFrame:
    return aggregates.top_rows(t.orders.select("o_orderkey", "o_totalprice"), 100, "o_totalprice", ["o_orderkey"])


@check(
    "top_half",
    """SELECT l_linenumber, l_orderkey, row_id FROM (
      SELECT l_linenumber, l_orderkey, row_id, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity, row_id) AS rn,
        count(*) OVER (PARTITION BY l_linenumber) AS n
      FROM (SELECT DISTINCT l_linenumber, l_orderkey, l_quantity, l_orderkey * 1000000 + l_partkey AS row_id FROM lineitem))
    WHERE rn <= (n + 1) // 2""",
)
def top_half(t: Tables) -> DataFrame:
    row_id = (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("row_id")
    rows = t.lineitem.select("l_linenumber", "l_orderkey", "l_quantity", row_id).distinct()
    return selection.top_half(rows, ["l_linenumber"], "l_quantity", "row_id").drop("l_quantity")


def _ranked(column: str, parts: tuple[tuple[int, int], ...]) -> str:
    hits = ", ".join(f"max(CASE WHEN rn = greatest(1, (n * {p} + {w} - 1) // {w}) THEN v END)" + f" AS q{k}" for k, (p, w) in enumerate(parts))
    return f"""SELECT event_type, {hits} FROM (SELECT event_type, {column} AS v, row_number() OVER (PARTITION BY event_type ORDER BY {column}) AS rn,
      count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type"""


@check(
    "discrete_quantiles",
    f"""SELECT t.event_type, t.q0 AS low_name, t.q1 AS middle_name, t.q2 AS high_name, strftime(s.q0, '%Y-%m-%d %H:%M:%S') AS middle_ts, v.q0 AS tail_value
    FROM ({_ranked("'ORDER-0000000000000000-' || lpad(CAST(event_id * 7919 % 100003 AS VARCHAR), 6, '0')", ((1, 4), (1, 2), (9, 10)))}) t
    JOIN ({_ranked("ts", ((1, 2),))}) s USING (event_type) JOIN ({_ranked("value", ((99, 100),))}) v USING (event_type)""",
)
def discrete_quantiles(t: Tables) -> DataFrame:
    """Quantiles of texts that begin alike, of times and of fractions."""
    name = F.concat(F.lit("ORDER-0000000000000000-"), F.lpad((F.col("event_id") * 7919 % 100003).cast("string"), 6, "0"))
    rows = t.events.select("event_type", name.alias("name"), "ts", "value")
    names = selection.discrete_quantiles(rows, ["event_type"], "name", {"low_name": (1, 4), "middle_name": (1, 2), "high_name": (9, 10)})
    times_ = selection.discrete_quantiles(rows, ["event_type"], "ts", {"middle_ts": (1, 2)})
    return names.join(times_, "event_type").join(selection.discrete_quantiles(rows, ["event_type"], "value", {"tail_value": (99, 100)}), "event_type")


@check(
    "weekly_actives",
    """SELECT event_type, CAST(date_trunc('week', ts) AS DATE)::VARCHAR AS period, 'week' AS kind, count(DISTINCT user_id) AS actives FROM events GROUP BY 1, 2
    UNION ALL SELECT e.event_type, CAST(d.day AS VARCHAR), 'rolling', count(DISTINCT e.user_id)
      FROM (SELECT DISTINCT CAST(ts AS DATE) + s AS day FROM events, (SELECT unnest(range(0, 7))::INTEGER AS s)) d
      JOIN events e ON CAST(e.ts AS DATE) BETWEEN d.day - 6 AND d.day WHERE d.day <= (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2""",
)
def weekly_actives(t: Tables) -> DataFrame:
    """Distinct users by week and over seven days, from stored daily bitmaps; one day comes in two parts."""
    late = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-11") & (F.col("event_id") % 2 == 0)
    parts = [actives.daily_bitmaps(t.events.filter(rows), "ts", "user_id", ["event_type"]) for rows in (~late, late)]
    days = actives.merged_days(tables.staged(parts[0].unionByName(parts[1]), "daily-users"), ["event_type"])
    weeks = actives.actives(days, F.date_trunc("week", F.col("day").cast("timestamp_ntz")).cast("date"), "period", ["event_type"])
    rolling = actives.rolling_actives(days, 7, ["event_type"]).withColumnRenamed("day", "period")
    kinds = [df.withColumn("kind", F.lit(kind)) for df, kind in ((weeks, "week"), (rolling, "rolling"))]
    return kinds[0].unionByName(kinds[1])


@check(
    "calendar_spine",
    """SELECT CAST(d.day AS VARCHAR) AS day, count(o.o_orderkey) AS orders
    FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.day GROUP BY 1""",
)
def calendar_spine(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("o_orderkey").alias("orders"))
    return calendars.fill_days(daily, "day", "1994-12-01", "2001-12-31", ["orders"])


# --- expressions --------------------------------------------------------------------


@check(
    "date_parts",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, hour(ts) AS hour, minute(ts) AS minute, dayname(ts) AS weekday FROM events""",
)
def date_parts(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        F.to_date(ts).alias("day"),
        F.hour(ts).alias("hour"),
        F.minute(ts).alias("minute"),
        times.weekday_name(ts).alias("weekday"),
    )


@check(
    "date_math",
    f"""WITH {USERS} SELECT e.event_id, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later,
      strftime(ts - INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS month_ago, date_diff('day', signup_ts, ts) AS days,
      date_diff('second', date_trunc('second', signup_ts), date_trunc('second', ts)) AS seconds,
      CAST(floor(date_diff('day', birthday, CAST(ts AS DATE)) / 365) AS BIGINT) AS age
    FROM events e JOIN users u ON u.user_id = e.user_id""",
)
def date_math(t: Tables) -> DataFrame:
    ts = F.col("ts")
    users = t.users.select("user_id", "signup_ts", "birthday")
    return t.events.join(users, ["user_id"]).select(
        "event_id",
        times.shift(ts, 90, "MINUTE").alias("later"),
        times.shift(ts, -1, "MONTH").alias("month_ago"),
        times.days_between(F.col("signup_ts"), ts).alias("days"),
        times.seconds_between(F.col("signup_ts"), ts).alias("seconds"),
        times.age_in_years(F.col("birthday"), ts).alias("age"),
    )


@check(
    "us_week",
    """SELECT year(o_orderdate) AS year, (dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) // 7 + 1 AS week,
      count(*) AS orders FROM orders GROUP BY 1, 2""",
)
def us_week(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        F.year("o_orderdate").alias("year"), times.us_week(F.col("o_orderdate")).alias("week")
    ).agg(F.count(F.lit(1)).alias("orders"))


@check(
    "string_functions",
    """SELECT p_partkey, left(p_name, 3) AS head, right(p_name, 3) AS tail, right(left(p_name, 7), 1) AS seventh,
      substring(p_name, 1, 5) AS prefix, left(p_name, 5) AS zero_based, substring(p_name, 4, 300) AS rest, replace(p_type, 'O', '') AS replaced,
      length(rtrim(p_name || '  ')) AS size, p_brand || '/' || p_type AS joined, left(right(CAST(p_partkey + 10000 AS VARCHAR), 4), 2) AS shard
    FROM part""",
)
def string_functions(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        texts.head(name, 3).alias("head"),
        texts.tail(name, 3).alias("tail"),
        texts.char_at(name, 7).alias("seventh"),
        texts.slice_text(name, 1, 5).alias("prefix"),
        texts.slice_text(name, 0, 6).alias("zero_based"),
        texts.slice_text(name, 4, 300).alias("rest"),
        texts.without(F.col("p_type"), "O").alias("replaced"),
        texts.text_length(F.concat(name, F.lit("  "))).alias("size"),
        texts.joined_text(F.col("p_brand"), "/", F.col("p_type")).alias("joined"),
        texts.id_shards(F.col("p_partkey") + 10000)[0].alias("shard"),
    )


@check(
    "int_division",
    """SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT))::BIGINT // count(DISTINCT l_suppkey) AS per_supplier,
      CASE WHEN min(l_linenumber) - 1 = 0 THEN NULL ELSE sum(CAST(l_quantity AS BIGINT))::BIGINT // (min(l_linenumber) - 1) END AS guarded
    FROM lineitem GROUP BY l_orderkey""",
)
def int_division(t: Tables) -> DataFrame:
    total = F.sum(F.col("l_quantity").cast("bigint"))
    return t.lineitem.groupBy("l_orderkey").agg(
        numbers.int_div(total, F.count_distinct("l_suppkey")).alias("per_supplier"),
        numbers.int_div(total, F.min("l_linenumber") - 1).alias("guarded"),
    )


@check(
    "decimal_casts",
    """SELECT l_shipmonth AS month, CAST(CAST(sum(cents) // 100 AS BIGINT) AS DOUBLE) AS whole,
      CAST((2 * sum(cents) + 300) // 600 AS DOUBLE) / 100 AS per_second, abs(CAST(sum(cents) // 100 AS BIGINT) - 50000) AS distance
    FROM (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS l_shipmonth,
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents FROM lineitem) GROUP BY 1""",
)
def decimal_casts(t: Tables) -> DataFrame:
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint")
    total = F.sum(numbers.money(F.col("l_extendedprice")))
    return t.lineitem.groupBy(month.alias("month")).agg(
        F.floor(total).cast("decimal(18,0)").alias("whole"),
        F.round(total / 300, 2).cast("decimal(18,2)").alias("per_second"),
        F.abs(F.floor(total).cast("bigint") - 50000).alias("distance"),
    )


XML_SQL = """WITH x AS (SELECT event_id, '<Log><Score>' || CAST(CAST(value / 10 AS DECIMAL(18,3)) AS VARCHAR) || '</Score><IsInTest>'
        || CASE WHEN event_type = 'view' THEN 'True' ELSE 'false' END || '</IsInTest>'
        || CASE WHEN value < 50 THEN '<Honored>1</Honored>' ELSE '' END || '</Log>' AS details FROM events)
    SELECT event_id, CAST(regexp_extract(details, '<Score>([0-9.]*)</Score>', 1) AS DOUBLE) AS score,
      CASE WHEN lower(regexp_extract(details, '<IsInTest>(.*)</IsInTest>', 1)) = 'true' THEN 1 ELSE 0 END::BIGINT AS in_test,
      CASE WHEN details LIKE '%<Honored>%' THEN 1 ELSE 0 END::BIGINT AS honored FROM x"""


@check("xml_extract", XML_SQL)
def xml_extract(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", details_of(F.col("value"), F.col("event_type")).alias("details"))
    paths = ["//Score", "//IsInTest", "//Honored"]
    details = F.col("details")
    return rows.select("event_id", extract.xml_texts(F.col("details"), paths).alias("details")).select(
        "event_id",
        extract.xml_value(details, "//Score", "decimal(20,5)", paths).alias("score"),
        F.when(extract.is_true(extract.xml_value(details, "//IsInTest", among=paths)), 1).otherwise(0).alias("in_test"),
        F.coalesce(extract.xml_value(details, "//Honored", "int", paths), F.lit(0)).alias("honored"),
    )


@check("xml_record", XML_SQL)
def xml_record(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", details_of(F.col("value"), F.col("event_type")).alias("details"))
    parsed = extract.xml_record(F.col("details"), "Score decimal(20,5), IsInTest string, Honored int")
    return rows.select("event_id", parsed.alias("d")).select(
        "event_id",
        F.col("d.Score").alias("score"),
        F.when(extract.is_true(F.col("d.IsInTest")), 1).otherwise(0).alias("in_test"),
        F.coalesce("d.Honored", F.lit(0)).alias("honored"),
    )


def details_of(value, event_type):
    """An XML detail text made from an event."""
    score = (value / 10).cast("decimal(18,3)").cast("string")
    return F.concat(
        F.lit("<Log><Score>"),
        score,
        F.lit("</Score><IsInTest>"),
        F.when(event_type == "view", "True").otherwise("false"),
        F.lit("</IsInTest>"),
        F.when(value < 50, "<Honored>1</Honored>").otherwise(""),
        F.lit("</Log>"),
    )


@check(
    "json_extract",
    "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events",
)
def json_extract(t: Tables) -> DataFrame:
    props = F.col("props")
    return t.events.select(
        "event_id",
        extract.json_value(props, "$.k", "bigint").alias("k"),
        extract.json_value(props, "$.absent").alias("absent"),
    )


@check(
    "banding",
    """SELECT CASE WHEN score > 18 THEN 'Group 01' WHEN score > 1.5 THEN 'Group 02' WHEN score > 0.8 THEN 'Group 03'
      WHEN score > 0.4 THEN 'Group 04' ELSE 'Group 05' END AS band, count(*) AS n
    FROM (SELECT CAST(value / 10 AS DECIMAL(20,5)) AS score FROM events) GROUP BY 1""",
)
def banding(t: Tables) -> DataFrame:
    score = (F.col("value") / 10).cast("decimal(20,5)")
    edges = [F.lit(e).cast("decimal(20,5)") for e in fixed.SCORE_EDGES]
    return t.events.groupBy(labels.band(score, edges, fixed.SCORE_GROUPS).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "code_labels",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Man seeking Men' WHEN 'AUTOMOBILE' THEN 'Man seeking Women'
      WHEN 'MACHINERY' THEN 'Woman seeking Women' WHEN 'HOUSEHOLD' THEN 'Woman seeking Men' END AS seeking,
      CASE WHEN c_nationkey >= 1 THEN chr(64 + c_nationkey) END AS letter FROM customer""",
)
def code_labels(t: Tables) -> DataFrame:
    return t.users.select(
        F.col("user_id").alias("c_custkey"),
        labels.code_label(F.col("seeking"), fixed.SEEKING).alias("seeking"),
        labels.letter_of(F.col("nation_key")).alias("letter"),
    )


@check(
    "classify_rules",
    f"""WITH {LOG} SELECT CASE WHEN left(host, 2) = 'DA' THEN 'ClearView' ELSE 'DuPont' END AS site,
      CASE WHEN CAST(right(host, 3) AS INTEGER) BETWEEN 141 AND 157 THEN 'Mobile'
        WHEN CAST(right(host, 3) AS INTEGER) BETWEEN 211 AND 214 THEN 'G3' ELSE 'Main' END AS platform, count(*) AS n
    FROM log GROUP BY 1, 2""",
)
def classify_rules(t: Tables) -> DataFrame:
    host = F.col("host")
    return t.log.groupBy(
        monitoring.site_of(host).alias("site"), monitoring.platform_of(host).alias("platform")
    ).agg(F.count(F.lit(1)).alias("n"))
