"""Checks of the sales, activity and partner jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.checks.entities import AS_OF, LOG, SALES, TRX, USERS, Tables
from cohortdeck.checks.registry import check, sql_rate
from cohortdeck.functions import labels, times
from cohortdeck.plans import activity, sales

START = "2023-12-30"

DAYS = """days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)"""
FIRSTS = """firsts AS (SELECT day, count(user_id) AS new_users FROM (SELECT user_id, min(day) AS day FROM sales GROUP BY 1) GROUP BY 1)"""


def _calendar_rates(purchases: str) -> str:
    return f"""{sql_rate(purchases, "buyers", 3)} AS rate_today, {sql_rate(purchases, "new_users", 3)} AS rate_new"""


@check(
    "daily_by_platform",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, upper(event_type) AS description, count(*) AS metric_value
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' AND event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2""",
)
def daily_by_platform(t: Tables) -> DataFrame:
    kinds = t.events.select("event_type").distinct()
    names = kinds.select("event_type", F.upper("event_type").alias("description"))
    return activity.daily_by_dimension(
        t.events, "ts", "event_type", names, "event_type", "description", AS_OF, 30, ["view", "click", "purchase"]
    )


@check(
    "sales_calendar",
    f"""WITH {LOG}, {SALES}, {DAYS}, {FIRSTS}, c AS (
      SELECT d.day, count(s.sale_id) AS purchases, count(DISTINCT s.user_id) AS buyers, coalesce(f.new_users, 0) AS new_users
      FROM days d LEFT JOIN sales s ON s.day = d.day LEFT JOIN firsts f ON f.day = d.day GROUP BY d.day, coalesce(f.new_users, 0))
    SELECT CAST(day AS VARCHAR) AS purchase_date, purchases, buyers, new_users, {_calendar_rates("purchases")} FROM c""",
)
def sales_calendar(t: Tables) -> DataFrame:
    return sales.sales_calendar(t.sales, "sale_id", "user_id", "ts", START, AS_OF)


@check(
    "sales_calendar_by_group",
    f"""WITH {LOG}, {SALES}, {USERS}, {DAYS}, {FIRSTS}, c AS (
      SELECT d.day, u.segment, count(s.sale_id) AS purchases, count(DISTINCT s.user_id) AS buyers, coalesce(f.new_users, 0) AS new_users
      FROM days d LEFT JOIN sales s ON s.day = d.day JOIN users u ON u.user_id = s.user_id LEFT JOIN firsts f ON f.day = d.day
      GROUP BY d.day, u.segment, coalesce(f.new_users, 0))
    SELECT CAST(day AS VARCHAR) AS purchase_date, segment, purchases, buyers, new_users, {_calendar_rates("purchases")} FROM c""",
)
def sales_calendar_by_group(t: Tables) -> DataFrame:
    return sales.sales_calendar_by_group(t.sales, "sale_id", "user_id", "ts", t.users, "segment", START, AS_OF)


@check(
    "sales_by_validity",
    f"""WITH {LOG}, {SALES}, {DAYS}, valid AS (SELECT user_id, ts AS begin_ts, ts + INTERVAL 5 DAY AS end_ts FROM log WHERE event_type = 'signup'),
      stated AS (SELECT s.day, s.user_id, CASE WHEN v.user_id IS NULL THEN 'Non-Sub' ELSE 'Sub' END AS state FROM sales s
        LEFT JOIN valid v ON v.user_id = s.user_id AND v.begin_ts <= s.ts AND v.end_ts > s.ts)
    SELECT CAST(d.day AS VARCHAR) AS purchase_date, s.state, count(DISTINCT s.user_id) AS buyers
    FROM days d LEFT JOIN stated s ON s.day = d.day GROUP BY 1, 2""",
)
def sales_by_validity(t: Tables) -> DataFrame:
    valid = t.log_of("signup").select(
        "user_id", F.col("ts").alias("begin_ts"), times.shift(F.col("ts"), 5, "DAY").alias("end_ts")
    )
    return sales.sales_by_validity(t.sales, "user_id", "ts", valid, "begin_ts", "end_ts", START, AS_OF)


CHAIN = """chain AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE p_type = 'PROMO' AND o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1995-02-01')"""


def _revenue(t: Tables, by_day: bool) -> DataFrame:
    tests = [F.col("p_type") == "PROMO", F.col("o_orderstatus") != "P"]
    return sales.revenue(t.billing_chain, "amount", "o_orderdate", tests, "1995-02-01", by_day)


@check("revenue_total", f"WITH {CHAIN} SELECT CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS line_count FROM chain")
def revenue_total(t: Tables) -> DataFrame:
    return _revenue(t, False)


@check(
    "revenue_daily",
    f"""WITH {CHAIN} SELECT CAST(day AS VARCHAR) AS metric_date, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS line_count FROM chain GROUP BY day""",
)
def revenue_daily(t: Tables) -> DataFrame:
    return _revenue(t, True)


PRICE_CASE = "CASE " + " ".join(
    f"WHEN substring(testing_guid, 7, 1) IN ({', '.join(repr(d) for d in digits)}) THEN '{label}'"
    for label, digits in fixed.PRICE_POINTS.items()
) + " END"


@check(
    "arpu_by_cohort_day",
    f"""WITH {TRX}, {USERS}, x AS (SELECT t.day, {PRICE_CASE} AS cohort, t.user_id, CAST(t.amount * 100 AS BIGINT) AS cents
      FROM trx t JOIN users u ON u.user_id = t.user_id WHERE t.status = 1),
      g AS (SELECT day, cohort, count(DISTINCT user_id) AS users, sum(cents)::BIGINT AS cents FROM x GROUP BY 1, 2)
    SELECT CAST(day AS VARCHAR) AS purchase_date, cohort, users, CAST(cents AS DOUBLE) / 100 AS revenue,
      CAST((2 * cents * 100 + users) // (2 * users) AS DOUBLE) / 10000 AS arpu FROM g""",
)
def arpu_by_cohort_day(t: Tables) -> DataFrame:
    paid = t.trx.filter(F.col("status") == fixed.STATUS_SUCCESS)
    return sales.price_point_daily(paid, "user_id", "ts", "amount", t.users, "testing_guid")


@check(
    "events_in_interval",
    """WITH buys AS (SELECT event_id, user_id, ts AS begin_ts, ts + INTERVAL 40 HOUR AS end_ts FROM events WHERE event_type = 'purchase'),
      x AS (SELECT b.event_id, CAST(b.begin_ts AS DATE) AS day, count(1) AS n FROM buys b
        LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') v
        ON v.user_id = b.user_id AND v.ts BETWEEN b.begin_ts AND b.end_ts GROUP BY 1, 2)
    SELECT CAST(day AS VARCHAR) AS start_date, count(event_id) AS buyers, sum(n)::BIGINT AS impressions, sum(n)::BIGINT // count(event_id) AS per_buyer
    FROM x GROUP BY day""",
)
def events_in_interval(t: Tables) -> DataFrame:
    bought = t.log_of("purchase").select(
        "event_id", "user_id", F.col("ts").alias("begin_ts"), times.shift(F.col("ts"), 40, "HOUR").alias("end_ts")
    )
    views = t.log_of("view").select("user_id", "ts")
    return sales.impressions_per_buyer(bought, "event_id", "user_id", "begin_ts", "end_ts", views, "user_id", "ts")


@check(
    "lapse_lookback",
    """WITH lapses AS (SELECT user_id, CAST(ts AS DATE) AS lapse_date FROM events WHERE event_type = 'signup'),
      x AS (SELECT l.lapse_date, CASE WHEN c.user_id IS NOT NULL THEN 1 ELSE 0 END AS hit FROM lapses l
        LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click' AND value > 120) c
        ON c.user_id = l.user_id AND c.ts >= CAST(l.lapse_date AS TIMESTAMP) - INTERVAL 7 DAY)
    SELECT CAST(lapse_date AS VARCHAR) AS lapse_date, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END)::BIGINT AS no_contact,
      sum(CASE WHEN hit = 1 THEN 1 ELSE 0 END)::BIGINT AS has_contact FROM x GROUP BY 1""",
)
def lapse_lookback(t: Tables) -> DataFrame:
    lapses = t.log_of("signup").select("user_id", F.to_date("ts").alias("lapse_date"))
    clicks = t.log_of("click").filter(F.col("amount") > 120).select("user_id", "ts")
    return sales.lapse_contact(lapses, "user_id", "lapse_date", clicks, "user_id", "ts")


@check(
    "redemption_split",
    f"""WITH {USERS}, grants AS (SELECT user_id, CASE WHEN value > 30 THEN ts END AS begin_ts FROM events WHERE event_type = 'purchase')
    SELECT sum(CASE WHEN begin_ts IS NOT NULL AND signup_ts >= TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END)::BIGINT AS redeemed,
      sum(CASE WHEN begin_ts IS NULL AND signup_ts >= TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END)::BIGINT AS not_redeemed,
      sum(CASE WHEN signup_ts < TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END)::BIGINT AS not_active
    FROM grants g JOIN users u ON u.user_id = g.user_id""",
)
def redemption_split(t: Tables) -> DataFrame:
    grants = t.log_of("purchase").select("user_id", F.when(F.col("amount") > 30, F.col("ts")).alias("begin_ts"))
    members = t.users.select("user_id", F.to_date("signup_ts").alias("last_login"))
    return sales.redemption(grants, "user_id", "begin_ts", members, "last_login", "2024-01-01")


@check(
    "search_impressions",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, event_type, count(DISTINCT user_id) AS impressions,
      sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM events GROUP BY 1, 2""",
)
def search_impressions(t: Tables) -> DataFrame:
    return sales.search_impressions(t.events, "ts", ["event_type"], "user_id", F.col("value") > 100)


@check(
    "top_buyers",
    f"""WITH {USERS}, places AS (SELECT n_nationkey, n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
      best AS (SELECT o_custkey AS user_id, count(*) AS purchases FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 100)
    SELECT b.user_id, u.handle, CAST(floor(date_diff('day', birthday, DATE '2024-01-31') / 365) AS BIGINT) AS age,
      CASE seeking WHEN 1 THEN 'Man seeking Men' WHEN 2 THEN 'Man seeking Women' WHEN 3 THEN 'Woman seeking Women'
        WHEN 4 THEN 'Woman seeking Men' END AS seeking_label, n_name, r_name,
      'img/' || left(right(CAST(b.user_id AS VARCHAR), 4), 2) || '/' || right(right(CAST(b.user_id AS VARCHAR), 4), 2) || '/'
        || CAST(b.user_id AS VARCHAR) || CASE WHEN nation_key >= 1 THEN chr(64 + nation_key) END || '.jpg' AS image_path,
      'profile/' || handle AS profile_path, purchases
    FROM best b JOIN users u ON u.user_id = b.user_id
    JOIN (SELECT n_nationkey, n_name, r_name FROM places) p ON p.n_nationkey = u.nation_key""",
)
def top_buyers(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    region_of = t.nation.select(F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key"))
    users = t.users.select(
        "user_id", "handle", "birthday", "seeking", "nation_key", labels.letter_of(F.col("nation_key")).alias("photo")
    ).join(region_of, ["nation_key"])
    geo = places.select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key"), "n_name", "r_name"
    )
    return sales.top_buyers(
        t.orders.select(F.col("o_custkey").alias("user_id")),
        "user_id",
        users,
        geo,
        ["nation_key", "region_key"],
        ["n_name", "r_name"],
        AS_OF,
        100,
        "img/",
        "profile/",
    )


@check(
    "adoption_daily",
    f"""WITH {TRX}, {USERS} SELECT CAST(t.day AS VARCHAR) AS metric_date,
      CASE WHEN seeking IN (1, 2) THEN 'Men' WHEN seeking IN (3, 4) THEN 'Women' END AS segment, count(*) AS metric_value
    FROM trx t JOIN users u ON u.user_id = t.user_id WHERE login_disabled NOT IN (1, 2) AND t.ts >= TIMESTAMP '1995-03-01'
      AND t.ts < TIMESTAMP '2001-07-01' GROUP BY 1, 2""",
)
def adoption_daily(t: Tables) -> DataFrame:
    return _adoptions(t)


def _adoptions(t: Tables) -> DataFrame:
    members = t.users.filter(~F.col("login_disabled").isin(*fixed.DISABLED_LOGINS))
    return activity.adoption(
        t.trx, "ts", "user_id", members, "seeking", fixed.SEGMENT_OF_SEEKING, "1995-03-01", "2001-07-01"
    )


@check(
    "adoption_pivot",
    f"""WITH {TRX}, {USERS} SELECT CAST(t.day AS VARCHAR) AS metric_date,
      sum(CASE WHEN seeking IN (1, 2) THEN 1 END)::BIGINT AS men, sum(CASE WHEN seeking IN (3, 4) THEN 1 END)::BIGINT AS women
    FROM trx t JOIN users u ON u.user_id = t.user_id WHERE login_disabled NOT IN (1, 2) AND t.ts >= TIMESTAMP '1995-03-01'
      AND t.ts < TIMESTAMP '2001-07-01' GROUP BY 1""",
)
def adoption_pivot(t: Tables) -> DataFrame:
    return activity.adoption_pivot(_adoptions(t), {"Men": "men", "Women": "women"})


@check(
    "daily_share",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS total,
      sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS flagged,
      CAST((2 * sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT * 1000000 + count(*)) // (2 * count(*)) AS DOUBLE) / 10000
        AS flagged_percent FROM orders GROUP BY 1""",
)
def daily_share(t: Tables) -> DataFrame:
    return activity.daily_share(t.orders, "o_orderdate", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@check(
    "population_share",
    f"""WITH s AS (SELECT c_mktsegment AS segment, count(*) AS size FROM customer GROUP BY 1)
    SELECT segment, {sql_rate("sum(size)", "(SELECT sum(size) FROM s)", 6)} AS share FROM s GROUP BY 1""",
)
def population_share(t: Tables) -> DataFrame:
    stored = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("size"))
    return activity.population_share(stored, "segment", "size")


@check(
    "merged_metrics",
    """SELECT CAST(day AS VARCHAR) AS metric_date, sum(created)::BIGINT AS created, sum(presented)::BIGINT AS presented, sum(clicked)::BIGINT AS clicked FROM (
      SELECT CAST(o_orderdate + INTERVAL 276 MONTH AS DATE) AS day, 1 AS created, 0 AS presented, 0 AS clicked FROM orders
        WHERE o_orderdate + INTERVAL 276 MONTH >= TIMESTAMP '2018-01-02' AND o_orderdate + INTERVAL 276 MONTH < TIMESTAMP '2024-01-31'
      UNION ALL SELECT CAST(ts AS DATE), 0, 1, 0 FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-31'
      UNION ALL SELECT CAST(ts AS DATE), 0, 0, 1 FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-31') GROUP BY 1""",
)
def merged_metrics(t: Tables) -> DataFrame:
    created = t.orders.select(times.shift(F.col("o_orderdate"), 276, "MONTH").alias("ts"))
    return activity.merged_daily_metrics(
        {"created": (created, "ts"), "presented": (t.log_of("view"), "ts"), "clicked": (t.log_of("click"), "ts")},
        AS_OF,
        2220,
    )


CHAIN = """chain AS (SELECT o_orderdate AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
    WHERE o_orderstatus IN ('F', 'O') AND left(o_orderpriority, 1) IN ('1', '3') AND o_custkey % 5 IN (1, 4) AND p_size % 7 = 2 AND s_nationkey < 20
      AND o_orderdate >= TIMESTAMP '1996-01-01')"""


@check("billing_chain_daily", f"WITH {CHAIN} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS line_count FROM chain GROUP BY 1")
def billing_chain_daily(t: Tables) -> DataFrame:
    """Daily revenue of a feature from the six tables of the chain."""
    trx = t.trx.select("trx_id", "user_id", "ts", "amount", F.substring("priority", 1, 1).cast("int").alias("trx_type"), "status", (F.col("user_id") % 5).alias("category"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    detail = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("account_detail_id")
    trx_details = lines.select(F.col("l_orderkey").alias("trx_id"), detail)
    account_details = lines.select(detail, F.col("l_suppkey").alias("order_id"), F.col("l_partkey").alias("product_detail_id"))
    orders = t.supplier.filter(F.col("s_nationkey") < 20).select(F.col("s_suppkey").alias("order_id"))
    product_details = t.part.select(F.col("p_partkey").alias("product_detail_id"), F.col("p_size").alias("product_id"))
    products = t.part.select(F.col("p_size").alias("product_id"), (F.col("p_size") % 7).alias("feature_id")).distinct()
    chain = sales.billing_chain(
        trx, trx_details, account_details, orders, product_details, products, [2], [1, 3], statuses=[1, 2], start="1996-01-01"
    )
    return sales.revenue(chain, "amount", "ts", by_day=True)
