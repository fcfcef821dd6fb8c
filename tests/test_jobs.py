"""Jobs on hand-made frames with literal expected rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortdeck.plans import activity, billing, cohorts, experiments, funnels, messaging, monitoring, sales


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def day(n):
    return dt.date(2024, 1, n)


# --- cohorts ------------------------------------------------------------------------


def test_fraud_rule_edges(spark, rows):
    signup = at(1)
    users = spark.createDataFrame([(i, signup) for i in range(1, 8)], "user_id int, signup_ts timestamp_ntz")
    limit = signup + dt.timedelta(seconds=604800)
    resigned = spark.createDataFrame(
        [
            (1, "K", 1, limit - dt.timedelta(seconds=1)),
            (2, "K", 1, limit),
            (3, "K", 42, at(2)),
            (4, "M", 1, at(2)),
            (5, "K", 1, at(2)),
            (5, "K", 1, at(2)),
            (6, "K", None, at(2)),
            (7, "K", 1, signup - dt.timedelta(days=30)),
        ],
        "user_id int, resign_type string, resign_code int, resign_ts timestamp_ntz",
    )
    assert rows(cohorts.fraud_users(users, resigned)) == [(1,), (5,), (7,)]
    assert rows(cohorts.remove_fraud(users, resigned), "user_id") == [(2,), (3,), (4,), (6,)]


def test_scaled_control_of_dated_cohorts(spark, rows):
    df = spark.createDataFrame([("0", at(2))] * 4 + [("1", at(2))] * 6, "guid string, ts timestamp_ntz")
    found = cohorts.dated_cohort_counts(df, "guid", 1, "ts", [("Test", "0", "2024-01-01", None)])
    assert rows(found) == [(6, 2, 4)]
    none = cohorts.dated_cohort_counts(df, "guid", 1, "ts", [("Test", "9", "2024-01-01", None)])
    assert rows(none) == [(10, 3, None)]


# --- sales ------------------------------------------------------------------------------


SALES = "sale_id int, user_id int, ts timestamp_ntz"


def test_calendar_keeps_empty_days(spark, rows):
    data = [(1, 7, at(1, 5)), (2, 7, at(1, 6)), (3, 8, at(1, 7)), (4, 7, at(3, 1)), (5, 9, at(5))]
    found = sales.sales_calendar(spark.createDataFrame(data, SALES), "sale_id", "user_id", "ts", "2024-01-01", "2024-01-05")
    assert rows(found, "purchase_date", "purchases", "buyers", "new_users", "rate_today", "rate_new") == [
        (day(1), 3, 2, 2, Decimal("1.500"), Decimal("1.500")),
        (day(2), 0, 0, 0, None, None),
        (day(3), 1, 1, 0, Decimal("1.000"), None),
        (day(4), 0, 0, 0, None, None),
    ]


def test_group_calendar_drops_empty_days_unless_asked(spark, rows):
    data = spark.createDataFrame([(1, 7, at(1)), (2, 8, at(3))], SALES)
    groups = spark.createDataFrame([(7, "Test"), (8, "Control")], "user_id int, kind string")
    args = (data, "sale_id", "user_id", "ts", groups, "kind", "2024-01-01", "2024-01-04")
    assert rows(sales.sales_calendar_by_group(*args), "purchase_date", "kind") == [(day(1), "Test"), (day(3), "Control")]
    kept = rows(sales.sales_calendar_by_group(*args, keep_zero_days=True), "purchase_date", "kind", "purchases")
    assert (day(2), None, 0) in kept and len(kept) == 3


def test_buyer_without_impressions_counts_one(spark, rows):
    bought = spark.createDataFrame([(1, 7, at(1), at(2)), (2, 8, at(1), at(2))], "id int, u int, b timestamp_ntz, e timestamp_ntz")
    seen = spark.createDataFrame([(7, at(1)), (7, at(2)), (7, at(1, 5)), (7, at(2, 0, 1))], "u int, ts timestamp_ntz")
    args = (bought, "id", "u", "b", "e", seen, "u", "ts")
    assert rows(sales.impressions_per_buyer(*args)) == [(day(1), 2, 4, 2)]
    assert rows(sales.impressions_per_buyer(*args, count_matches=True)) == [(day(1), 2, 3, 1)]


def test_lapse_contacts_fan_out_unless_distinct(spark, rows):
    lapses = spark.createDataFrame([(1, day(20)), (2, day(20)), (3, day(20))], "u int, lapse date")
    mails = spark.createDataFrame([(1, at(13)), (1, at(30)), (2, at(12, 23, 59))], "u int, ts timestamp_ntz")
    args = (lapses, "u", "lapse", mails, "u", "ts")
    assert rows(sales.lapse_contact(*args)) == [(day(20), 2, 2)]
    assert rows(sales.lapse_contact(*args, distinct_users=True)) == [(day(20), 2, 1)]


def test_redemption_split(spark, rows):
    grants = spark.createDataFrame([(1, at(1)), (1, None), (2, None), (3, at(1))], "u int, b timestamp_ntz")
    members = spark.createDataFrame([(1, day(10)), (2, day(10)), (3, day(9))], "u int, login date")
    assert rows(sales.redemption(grants, "u", "b", members, "login", "2024-01-10")) == [(1, 2, 1)]


def test_top_buyers_rank_before_place_lookup(spark, rows):
    log = spark.createDataFrame([(12345,)] * 3 + [(22345,)] * 2 + [(3,)] * 9, "u int")
    users = spark.createDataFrame(
        [(12345, "ann", day(1), 1, "A", 1), (22345, "bob", day(1), None, None, 9)],
        "u int, handle string, birthday date, seeking int, photo string, place int",
    )
    places = spark.createDataFrame([(1, "Rome")], "place int, city string")
    found = sales.top_buyers(log, "u", users, places, ["place"], ["city"], "2025-01-01", 1, "p/", "q/")
    assert rows(found, "handle", "age", "image_path", "profile_path", "purchases") == [
        ("ann", 1, "p/23/45/12345A.jpg", "q/ann", 3)
    ]


# --- funnels ------------------------------------------------------------------------------


@pytest.fixture
def funnel(spark):
    """One subscriber with two transactions and two payments, one who only looked."""
    viewers = spark.createDataFrame(
        [(1, "s1", "Test"), (1, "s1", "Test"), (2, "s2", "Test"), (3, "s3", None), (4, "s4", "Control")],
        "user_id int, session_id string, cohort string",
    )
    pages = spark.createDataFrame(
        [(1, "s1", at(1, 10)), (1, "s1", at(1, 12)), (2, "s2", at(1, 10)), (1, "other", at(1, 1))],
        "user_id int, session_id string, ts timestamp_ntz",
    )
    bought = spark.createDataFrame(
        [
            (1, "s1", at(1, 11), 3, 0, 1),
            (1, "s1", at(1, 13), 6, 1, 5159),
            (1, "s1", at(1, 10), 1, 0, 1),
            (2, "s2", at(1, 9), 1, 0, 1),
        ],
        "user_id int, session_id string, ts timestamp_ntz, months int, is_bundled int, product_id int",
    )
    cash = spark.createDataFrame([(1, 10.0), (1, 5.0), (9, 99.0)], "user_id int, amount double")
    gone = spark.createDataFrame([(1,), (1,), (2,)], "user_id int")
    return viewers, pages, bought, cash, gone


def test_funnel_reference_fan_out(funnel, rows):
    found = funnels.conversion_funnel(*funnel)
    assert rows(found, "cohort", "viewers", "payment_viewers", "subs", "total_cash", "arpu", "resignations", "resign_rate") == [
        ("Control", 1, 0, 0, Decimal("0.0000"), Decimal("0.0000"), 0, Decimal("0.0000")),
        ("Test", 2, 2, 1, Decimal("30.0000"), Decimal("30.0000"), 4, Decimal("4.0000")),
    ]
    assert rows(found, "view_to_payment", "payment_to_sub", "view_to_sub")[-1] == (
        Decimal("1.0000"), Decimal("0.5000"), Decimal("0.5000"),
    )


def test_funnel_per_user(funnel, rows):
    found = funnels.conversion_funnel(*funnel, fanout="per_user")
    assert rows(found, "cohort", "total_cash", "resignations")[1] == ("Test", Decimal("15.0000"), 1)
    with pytest.raises(ValueError):
        funnels.conversion_funnel(*funnel, fanout="none")


def test_trx_summary_packages(funnel, rows):
    found = funnels.trx_summary(*funnel)
    assert rows(found, "cohort", "subs", "sum_square_cash", "pkg_1", "pkg_3", "pkg_6", "pkg_6_bundle", "pkg_6_upsell") == [
        ("Test", 1, Decimal("250.0000"), 0, 1, 0, 0, 1)
    ]


def test_prior_buyers_are_no_viewers(spark, rows):
    viewers = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    bought = spark.createDataFrame([(1, at(1)), (2, at(5))], "u int, ts timestamp_ntz")
    assert rows(funnels.without_prior_purchase(viewers, "u", bought, "ts", "2024-01-05")) == [(2,), (3,)]


def test_onboarding_limits(spark, rows):
    users = spark.createDataFrame(
        [(1, "a", at(1, 10), "v1"), (2, "b", at(1, 10), "v1"), (3, "c", at(1, 10), "Control")],
        "user_id int, session_id string, signup_ts timestamp_ntz, cohort string",
    )
    submissions = spark.createDataFrame(
        [(1, "a", at(1, 11), at(1, 12)), (2, "zz", at(1, 11), at(1, 12))],
        "user_id int, session_id string, submit_ts timestamp_ntz, approve_ts timestamp_ntz",
    )
    profiles = spark.createDataFrame(
        [(1, at(1, 11, 29), at(2), 5), (2, at(1, 11, 30), at(2), 5), (3, at(1, 10), None, 5)],
        "user_id int, create_ts timestamp_ntz, approve_ts timestamp_ntz, photo_id int",
    )
    photos = spark.createDataFrame([(1, 5, at(1, 12)), (1, 6, at(1, 10)), (2, 5, at(1, 10))], "user_id int, photo_id int, upload_ts timestamp_ntz")
    viewers = spark.createDataFrame([(1,), (1,), (2,)], "user_id int")
    buyers = spark.createDataFrame([(1,)], "user_id int")
    found = funnels.onboarding_funnel(users, submissions, profiles, photos, viewers, buyers)
    assert rows(found, "cohort", "users", "created", "submitted", "approved", "photo_approved", "viewers", "subs", "subs_per_viewer") == [
        ("v1", 2, 1, 1, 1, 1, 2, 1, Decimal("0.5000"))
    ]


def test_step_funnel_uses_last_success(spark, rows):
    requests = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "request_id int, site string")
    steps = spark.createDataFrame([(1, 1, 3), (1, 4, 3), (1, 5, 4), (2, 2, 3), (3, 4, 4)], "request_id int, step int, status int")
    assert rows(funnels.step_funnel(requests, steps, "site", {"two": 2, "four": 4})) == [("A", 2, 2, 1)]


# --- experiments --------------------------------------------------------------------------


def test_price_test_counts_cash_from_first_sale_on(spark, rows):
    sold = spark.createDataFrame(
        [(1, 10, at(5), 20.0, 0, 1, 30), (1, 11, at(7), 30.0, 0, 1, 90), (2, 12, at(5), 8.0, 1, 1, 30)],
        "user_id int, trx_id int, ts timestamp_ntz, amount double, cohort int, age int, days int",
    )
    paid = spark.createDataFrame(
        [(1, at(4), 1.0, True, True), (1, at(5), 20.0, False, True), (1, at(7), 30.0, True, True), (1, at(8), 100.0, True, False), (2, at(9), 8.0, True, True)],
        "user_id int, ts timestamp_ntz, amount double, is_renewal boolean, is_cash boolean",
    )
    gone = spark.createDataFrame([(1,), (2,)], "user_id int")
    args = (sold, paid, gone, "cohort", "age", 0)
    once = experiments.price_test_lift(*args)
    assert rows(once, "cohort", "users", "total_cash", "initial_cash", "renewal_cash", "users_indexed", "conversion") == [
        (0, 1, Decimal("50.00"), Decimal("20.00"), Decimal("30.00"), Decimal("1"), Decimal("0.00")),
        (1, 1, Decimal("8.00"), Decimal("8.00"), Decimal("8.00"), Decimal("1"), Decimal("33.33")),
    ]
    split = experiments.price_test_lift(*args, split=["days"])
    assert rows(split, "cohort", "users", "total_cash", "initial_cash")[0] == (0, 1, Decimal("80.00"), Decimal("50.00"))


def test_message_test_counts(spark, rows):
    users = spark.createDataFrame([(1, "Test"), (2, "Test"), (3, "Control")], "user_id int, cohort string")
    messages = spark.createDataFrame(
        [(1, 1, 9, 0), (1, 1, 9, 0), (2, 1, 9, 1), (3, 2, 9, 0), (4, 2, 8, 1), (5, 3, 8, 0)],
        "message_id int, sender_id int, recipient_id int, is_response int",
    )
    buyers = spark.createDataFrame([(1,), (1,)], "user_id int")
    assert rows(experiments.message_test(users, messages, buyers), "cohort", "users", "sent", "initial_contacts", "conversations", "subs") == [
        ("Test", 2, 4, 2, 1, 1)
    ]


def test_scaled_rates(spark, rows):
    stored = spark.createDataFrame([("0 - Control", 4, 2, Decimal("10.05")), ("1 - Test", 2, 1, Decimal("1.00"))], "cohort string, viewers int, subs int, cash decimal(10,2)")
    found = experiments.scaled_cohort_rates([stored, stored], "cohort", {"0 - Control": "1.5"}, {"cash": 2}, ["viewers", "subs"], {"rate": ("subs", "viewers")})
    assert rows(found, "cohort", "viewers", "cash", "rate") == [
        ("0 - Control", 8, Decimal("30.16"), Decimal("50.00")),
        ("1 - Test", 4, Decimal("2.00"), Decimal("50.00")),
    ]


# --- conversations ------------------------------------------------------------------------


def test_conversation_outcomes(spark, rows):
    alerts = spark.createDataFrame(
        [("s", 1, 2, 0, at(1)), ("s", 1, 2, 2, at(1)), ("s", 1, 2, 5, at(1)), ("t", 3, 2, 0, at(1)), ("u", 3, 9, 4, at(1))],
        "session_id string, from_user int, to_user int, status int, ts timestamp_ntz",
    )
    users = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "user_id int, login_disabled int")
    found = messaging.conversation_outcomes(alerts, users)
    assert rows(found, "senders", "recipients", "initiated", "accepted", "rejected", "senders_clean", "recipients_clean", "initiated_clean", "accepted_clean") == [
        (2, 1, 2, 1, None, 1, 0, 1, 1)
    ]


# --- monitoring ---------------------------------------------------------------------------


def log(spark, data):
    return spark.createDataFrame(data, "ts timestamp_ntz, host string, message string")


def test_new_messages_by_their_beginning(spark, rows):
    long_a, long_b = "x" * 199 + "A", "x" * 199 + "B"
    data = [(at(2, 8), "DA1", long_a), (at(2, 12, 30), "DA1", long_b), (at(2, 12, 30), "DA1", "fresh"), (at(2, 12, 40), "EC1", "fresh"), (at(2, 5), "DA1", "fresh")]
    site = monitoring.site_of(F.col("host"))
    found = monitoring.new_messages(log(spark, data), "ts", "message", site, "2024-01-02 13:00:00", min_count=0)
    assert rows(found, "message", "total", "clearview", "dupont") == [("fresh", 1, 0, 1), ("fresh", 1, 1, 0)]
    holed = log(spark, data + [(at(2, 9), "DA1", None)])
    assert monitoring.new_messages(holed, "ts", "message", site, "2024-01-02 13:00:00", min_count=0).count() == 0


def test_top_messages_percent_is_of_everything(spark, rows):
    df = log(spark, [(at(1), "DA1", "a")] * 3 + [(at(1), "EC1", "b")])
    found = monitoring.top_messages(df, "message", monitoring.site_of(F.col("host")), min_count=1)
    assert rows(found) == [("a", 3, 3, 0, Decimal("75.00"))]


def test_history_multiplies_by_flagged_platforms(spark, rows):
    daily = spark.createDataFrame([(day(1), "c", "o", "p", 5), (day(1), "c", "o", "q", 7)], "trace_date date, category string, item string, platform string, executions bigint")
    flagged = daily.select("category", "item", "platform")
    found = monitoring.hot_item_history(daily, flagged, ["category", "item"], "platform")
    assert rows(found, "platform", "metric_value") == [("p", 10), ("q", 14)]


def test_one_hour_alert_equals_all_hours(spark, rows):
    data = [(at(d, h, m), "p") for d in (1, 8, 15, 22, 29) for h in (9, 10) for m in range(d)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, page string")
    limits = {"new_page": 5, "catch_all": 20, "noise": 2}
    every = monitoring.hourly_alerts(df, "ts", ["page"], **limits).filter(F.col("hour_start") == at(29, 10))
    one = monitoring.hourly_alerts(df, "ts", ["page"], "2024-01-29 10:00:00", **limits)
    assert rows(one) == rows(every) and one.count() == 1


def test_excluded_hosts(spark, rows):
    df = log(spark, [(at(1), h, "m") for h in ("DA1WEB140", "DA1WEB141", "DA0WEB001", "EC1MIWS1", None)])
    assert rows(monitoring.monitored_hosts(df, "host"), "host") == [("DA1WEB140",)]


# --- billing, activity -----------------------------------------------------------------------


def test_payment_failures_by_account(spark, rows):
    trx = spark.createDataFrame([(at(1), "v", 1, 0), (at(1), "v", 2, 0), (at(1), "v", 3, 0), (at(1), "v", 2, 2)], "ts timestamp_ntz, card string, status int, login int")
    assert rows(billing.payment_failures(trx, "ts", ["card"], "status", "login")) == [
        (day(1), "v", 0, 2, 1), (day(1), "v", 1, 1, 1)
    ]


def test_listing_of_one_day(spark, rows):
    df = spark.createDataFrame([(1, at(2)), (2, at(2, 23, 59)), (3, at(3)), (4, at(1, 23))], "id int, ts timestamp_ntz")
    assert rows(billing.recent_listing(df, "ts", "2024-01-02 15:00:00", ["id"])) == [(1,), (2,)]
    assert rows(billing.recent_listing(df, "ts", "2024-01-02 23:00:00", ["id"], minutes=60)) == [(2,), (3,)]


def test_daily_share(spark, rows):
    df = spark.createDataFrame([(at(1), 1), (at(1), 2), (at(1), 3)], "ts timestamp_ntz, brand int")
    assert rows(activity.daily_share(df, "ts", F.col("brand").isin(1))) == [(day(1), 3, 1, Decimal("33.3333"))]


# --- slow pages and the billing chain from their tables ----------------------------------


def test_source_classes_by_first_rule(spark):
    aliases = ["x1MASS02", "masess", "DAL16", "q_masr7", "DAL17\\MAWRITE01", "MAREG", "MAREGWRITE", "1masa85", "MAOSDB\\MAOSDB01", "MASchEng", "MasCache", "MAPHOTO", "masp1", "chint", "DAL17", None]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(aliases)], "i int, a string")
    found = [r[0] for r in df.orderBy("i").select(monitoring.source_class(F.col("a"))).collect()]
    assert found == ["Session", "Session", "Read", "Read", "Write", "Reg", "Reg", "Reg", "OSDB", "Search Engine", "Cache", "Photo", "Photo", "Chem Int", "DAL17", None]


def test_slow_pages_need_both_bounds(spark, rows):
    now, old = "2024-01-01 12:00:00", "2024-01-01 10:00:00"
    ts = F.col("ts").cast("timestamp_ntz").alias("ts")
    headers = spark.createDataFrame(
        [(1, now, "EC1MAWS001", 6000, 6000), (2, old, "EC1MAWS001", 6000, 6000), (3, now, "EC1MAWS001", 4999, 1), (4, now, "DA1MAWS057", 9000, 1),
         (5, now, "DA1MAWS142", 9000, 1), (6, now, "DA1MAWS001", 5000, 1)],
        "seq int, ts string, host string, total_ms int, db_ms int",
    ).select("seq", ts, "host", "total_ms", "db_ms")
    details = spark.createDataFrame(
        [(1, now, 1, 1, 50), (1, old, 1, 1, 70), (1, now, 1, 1, 0), (1, now, 9, 1, 80), (2, now, 1, 1, 90), (6, old, 1, 2, 30)],
        "seq int, ts string, procedure_id int, alias_id int, component_ms int",
    ).select("seq", ts, "procedure_id", "alias_id", "component_ms")
    procedures = spark.createDataFrame([(1, "p1")], "procedure_id int, procedure string")
    aliases = spark.createDataFrame([(1, "MAREG"), (2, "DAL16")], "alias_id int, source string")
    tables = (headers, details, procedures, aliases, "2024-01-01 12:30:00")
    assert rows(monitoring.slow_page_details(*tables), "seq", "site", "source", "component_ms") == [(1, "DuPont", "MAREG", 50)]
    every = monitoring.slow_page_details(*tables, keep_without_details=True)
    assert rows(every, "seq", "procedure", "component_ms") == [(1, None, 80), (1, "p1", 0), (1, "p1", 50), (1, "p1", 70), (6, "p1", 30)]


def test_revenue_counts_a_transaction_per_detail(spark, rows):
    ts = "timestamp_ntz'2024-01-02'"
    trx = spark.sql(f"SELECT * FROM VALUES (1, 7, {ts}, 10.0, 14, 1, 1), (2, 7, {ts}, 5.0, 14, 2, 1), (3, 7, {ts}, 4.0, 14, 1, 4), (4, 7, {ts}, 3.0, 1, 1, 1) AS t(trx_id, user_id, ts, amount, trx_type, status, category)")
    trx_details = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, 4), (4, 1)], "trx_id int, account_detail_id int")
    account_details = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 9, 1)], "account_detail_id int, order_id int, product_detail_id int")
    orders = spark.createDataFrame([(1,)], "order_id int")
    product_details = spark.createDataFrame([(1, 1), (2, 2)], "product_detail_id int, product_id int")
    products = spark.createDataFrame([(1, 26), (2, 1)], "product_id int, feature_id int")
    chain = sales.billing_chain(trx, trx_details, account_details, orders, product_details, products, [26], [14])
    assert rows(sales.revenue(chain, "amount", "ts"), "revenue", "line_count") == [(Decimal("20.00"), 2)]
