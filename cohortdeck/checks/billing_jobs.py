"""Checks of the billing and import jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.checks.entities import LOG, TRX, USERS, Tables
from cohortdeck.checks.registry import check
from cohortdeck.functions import labels
from cohortdeck.plans import billing, funnels

STEPS = {"signup": 1, "view": 2, "click": 3, "purchase": 4}
REQUESTS = f"""requests AS (SELECT DISTINCT l.session_id AS request_id, u.segment FROM log l JOIN users u ON u.user_id = l.user_id),
  statuses AS (SELECT session_id AS request_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS step,
    CASE WHEN amount >= 20 THEN 3 ELSE 4 END AS status, message FROM log)"""


def _requests(t: Tables) -> tuple[DataFrame, DataFrame]:
    sessions = t.log.select("session_id", "user_id").distinct()
    requests = sessions.join(t.users.select("user_id", "segment"), ["user_id"]).select(
        F.col("session_id").alias("request_id"), "segment"
    )
    statuses = t.log.select(
        F.col("session_id").alias("request_id"),
        labels.code_label(F.col("event_type"), STEPS, 0).alias("step"),
        F.when(F.col("amount") >= 20, 3).otherwise(4).alias("status"),
        "message",
    )
    return requests, statuses


@check(
    "step_funnel",
    f"""WITH {USERS}, {LOG}, {REQUESTS}, piu AS (SELECT r.segment, s.step FROM requests r JOIN
      (SELECT request_id, max(step) AS step FROM statuses WHERE status = 3 GROUP BY 1) s ON s.request_id = r.request_id)
    SELECT DISTINCT segment, (SELECT count(1) FROM piu x WHERE x.segment = piu.segment) AS daily_total,
      (SELECT count(1) FROM piu x WHERE x.step >= 2 AND x.segment = piu.segment) AS not_existing,
      (SELECT count(1) FROM piu x WHERE x.step >= 3 AND x.segment = piu.segment) AS registered,
      (SELECT count(1) FROM piu x WHERE x.step >= 4 AND x.segment = piu.segment) AS profile_created FROM piu""",
)
def step_funnel(t: Tables) -> DataFrame:
    steps = {"not_existing": 2, "registered": 3, "profile_created": 4}
    return funnels.step_funnel(*_requests(t), "segment", steps)


@check(
    "error_counts",
    f"""WITH {USERS}, {LOG}, {REQUESTS} SELECT message, count(1) AS errors FROM requests r JOIN statuses s ON s.request_id = r.request_id WHERE s.status = 4 GROUP BY 1""",
)
def error_counts(t: Tables) -> DataFrame:
    return funnels.error_counts(*_requests(t))


@check(
    "coded_outcomes",
    """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS update_date, CASE l_linestatus WHEN 'F' THEN 'First' ELSE 'Unknown' END AS division_label,
      CASE l_returnflag WHEN 'A' THEN 'New Card Number' WHEN 'E' THEN 'Upd Expiration Date' ELSE 'Unknown' END AS response_label,
      CASE WHEN l_linenumber = 2 THEN 'Update Successful' WHEN l_linenumber = 4 THEN 'Cannot Identify Record To Update' WHEN l_linenumber = 5 THEN 'Too Many Records To Update'
        WHEN l_linenumber = 3 THEN 'Invalid New Card Length (16)' WHEN l_linenumber = 6 THEN 'Nothing To Update - Already Processed'
        WHEN l_linenumber < 2 THEN 'AcctPymtMethUV0 Exception' ELSE 'Unknown' END AS completion_label, count(1) AS cards
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-02-01' GROUP BY 1, 2, 3, 4""",
)
def coded_outcomes(t: Tables) -> DataFrame:
    updates = t.lineitem.select(
        F.col("l_shipdate").alias("ts"), "l_linestatus", "l_returnflag", (F.col("l_linenumber") - 2).alias("code")
    )
    return billing.coded_outcomes(
        updates, "ts", "2002-02-01", "l_linestatus", {"F": "First"}, "l_returnflag", "code", months=84
    )


@check(
    "payment_failures",
    f"""WITH {TRX}, {USERS} SELECT CAST(t.day AS VARCHAR) AS day, priority, segment, CASE WHEN u.login_disabled NOT IN (1, 2) THEN 0 ELSE 1 END::BIGINT AS login_disabled,
      sum(CASE WHEN status IN (1, 2) THEN 1 ELSE 0 END)::BIGINT AS total, sum(CASE WHEN status = 2 THEN 1 ELSE 0 END)::BIGINT AS failed
    FROM trx t JOIN users u ON u.user_id = t.user_id GROUP BY 1, 2, 3, 4""",
)
def payment_failures(t: Tables) -> DataFrame:
    users = t.users.select("user_id", "segment", "login_disabled")
    return billing.payment_failures(
        t.trx.join(users, ["user_id"]), "ts", ["priority", "segment"], "status", "login_disabled"
    )


@check(
    "recent_listing",
    """SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders
    WHERE date_diff('day', o_orderdate, TIMESTAMP '2001-07-15 09:00:00') = 0 AND o_orderpriority LIKE '%H%'""",
)
def recent_listing(t: Tables) -> DataFrame:
    return billing.recent_listing(
        t.orders,
        "o_orderdate",
        "2001-07-15 09:00:00",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"],
        filters=[F.col("o_orderpriority").contains("H")],
        order=["o_orderkey"],
    )


@check(
    "payment_failures_by_package",
    f"""WITH {USERS}, {TRX}, d AS (SELECT l_orderkey AS trx_id, l_partkey, l_suppkey FROM lineitem),
      r AS (SELECT t.day, t.status, CASE WHEN p_size <= 12 THEN 1 WHEN p_size <= 25 THEN 3 WHEN p_size <= 37 THEN 6 ELSE 12 END AS months,
        d.l_suppkey % 2 AS is_resub, t.priority AS card_type, CASE WHEN u.login_disabled IN (1, 2) THEN 1 ELSE 0 END AS login_disabled,
        CASE WHEN t.trx_id % 3 = 0 THEN 'S' || (t.trx_id % 2) END AS source_label
      FROM trx t JOIN users u USING (user_id) JOIN d USING (trx_id) JOIN part ON p_partkey = d.l_partkey
      WHERE t.amount >= 1000 AND t.ts >= TIMESTAMP '1997-01-01' AND p_brand <> 'Brand#1')
    SELECT strftime(day, '%Y-%m-%d') AS day, is_resub::BIGINT AS is_resub, months::BIGINT AS months, card_type, source_label, login_disabled::BIGINT AS login_disabled,
      count(*) FILTER (status IN (1, 2)) AS total, count(*) FILTER (status = 2) AS failed FROM r GROUP BY ALL""",
)
def payment_failures_by_package(t: Tables) -> DataFrame:
    """Failures over the whole billing chain: card, order, package and a source that may be missing."""
    trx = t.trx.select(
        "*", F.when(F.col("amount") >= 1000, 1).otherwise(2).alias("category"), F.lit(1).alias("trx_type"), F.col("priority").alias("method_id")
    )
    size = F.col("p_size")
    found = billing.card_transactions(
        trx,
        t.users,
        t.trx.select(F.col("priority").alias("method_id"), F.col("priority").alias("card_type")).distinct(),
        t.lineitem.select(
            F.col("l_orderkey").alias("trx_id"), F.col("l_suppkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("days")
        ),
        t.supplier.select(F.col("s_suppkey").alias("order_id"), (F.col("s_suppkey") % 2).alias("is_resub")),
        t.part.select(
            F.col("p_partkey").alias("product_id"),
            F.when(size <= 12, 1).when(size <= 25, 3).when(size <= 37, 6).otherwise(12).alias("months"),
            F.when(F.col("p_brand") == "Brand#1", 2).otherwise(1).alias("feature_id"),
        ),
        t.orders.filter("o_orderkey % 3 = 0").select(
            F.col("o_orderkey").alias("trx_id"), F.lit("sub").alias("sub_type"), F.concat(F.lit("S"), F.col("o_orderkey") % 2).alias("source_label")
        ),
        "1997-01-01",
    )
    return billing.payment_failures(found, "ts", ["is_resub", "months", "card_type", "source_label"], "status", "login_disabled")
