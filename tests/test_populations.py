"""Populations from logged evaluations, the billing chain, and slow pages, on literal rows."""

from datetime import datetime
from decimal import Decimal

from cohortdeck.functions.labels import package_months
from cohortdeck.plans import billing, monitoring, populations
from cohortdeck.sources import schemas, summaries


def day(n, hour=0):
    return datetime(2024, 1, n, hour)


ENTRIES = "entry_id int, asset_key string, details string"
USERS = "user_id int, testing_guid string, login_disabled int, signup_ts timestamp_ntz"


def evaluation(score, honored, in_test, down="false"):
    seen = f"<Honored>{honored}</Honored>" if honored else ""
    return f"<Log><Score>{score}</Score><ScoreRoundedDown>{down}</ScoreRoundedDown>{seen}<IsInTest>{in_test}</IsInTest></Log>"


def test_score_population(spark, rows):
    entries = spark.createDataFrame(
        [
            (1, "PriceTargetingV1Evaluated", evaluation("1.5", "1", "true", "True")),
            (2, "PriceTargetingV1Evaluated", evaluation("19", "true", "false")),
            (3, "PriceTargetingV1Evaluated", evaluation("0.4", "", "true")),
            (4, "Other", evaluation("5", "1", "true")),
        ],
        ENTRIES,
    )
    log = spark.createDataFrame(
        [(1, 1, "s1"), (1, 1, "s1"), (1, 2, "s2"), (1, 3, "s3"), (2, 2, "s4"), (3, 4, "s5"), (4, 1, "s6"), (5, 1, "s7"), (6, 1, "s8")],
        "user_id int, entry_id int, session_id string",
    )
    users = spark.createDataFrame(
        [(1, "012a", 0, day(5)), (2, "012b", 0, day(5)), (3, "012c", 0, day(5)), (4, "012d", 1, day(5)), (5, "012e", 0, day(20)), (6, "012f", 0, day(5))],
        USERS,
    )
    excluded = spark.createDataFrame([(6,)], "user_id int")
    found = populations.score_population(log, entries, users, excluded, day(1), day(10))
    # user 1: honoured in the test once, so the honoured row outside the test counts too, the unhonoured one doesn't
    assert rows(found, "user_id", "session_id", "score", "score_group", "score_rounded_down", "digit") == [
        (1, "s1", Decimal("1.50000"), "Group 03", 1, "A"),
        (1, "s2", Decimal("19.00000"), "Group 01", 0, "A"),
    ]


def card(promo, communication="false", one_click="false", mobile="false"):
    return (
        f"<RateCardLog><PromoId>{promo}</PromoId><IsCommunication>{communication}</IsCommunication>"
        f"<IsOneClick>{one_click}</IsOneClick><IsMobile>{mobile}</IsMobile></RateCardLog>"
    )


def test_promo_viewers(spark, rows):
    cards = [card("P1"), card("default"), card("P1", "true"), card("P1", one_click="true"), card("P1", mobile="true"), "<RateCardLog/>"]
    entries = spark.createDataFrame([(k, "RateCard", c) for k, c in enumerate(cards)], ENTRIES)
    log = spark.createDataFrame(
        [(1, k, "s", day(5)) for k in range(6)] + [(1, 0, "s", day(1)), (2, 0, "t", day(6)), (3, 0, "u", day(6))],
        "user_id int, entry_id int, session_id string, ts timestamp_ntz",
    )
    users = spark.createDataFrame([(1, "01", 0, day(2)), (2, "0F", 0, day(4)), (3, "01", 2, day(2))], USERS)
    found = populations.promo_viewers(log, entries, users, {"Test": "13579BDF", "Control": "02468ACE"}, day(3), day(9), position=2)
    assert rows(found, "user_id", "cohort", "session_id", "new_reg") == [(1, "Test", "s", 1), (2, "Test", "t", 0)]


def test_card_transactions_keep_what_has_no_source(spark, rows):
    trx = spark.createDataFrame(
        [(1, 7, day(2), 1, 1, 1, 12.9, 5), (2, 7, day(2), 2, 1, 1, 20.0, 5), (3, 7, day(2), 1, 2, 1, 9.0, 5), (4, 7, datetime(2020, 1, 1), 1, 1, 1, 9.0, 5)],
        "trx_id int, user_id int, ts timestamp_ntz, status int, category int, trx_type int, amount double, method_id int",
    )
    users = spark.createDataFrame([(7, 0)], "user_id int, login_disabled int")
    methods = spark.createDataFrame([(5, "Visa")], "method_id int, card_type string")
    details = spark.createDataFrame([(1, 1, 1, 90), (2, 1, 2, 30), (2, 1, 1, 30)], "trx_id int, order_id int, product_id int, days int")
    orders = spark.createDataFrame([(1, 0)], "order_id int, is_resub int")
    products = spark.createDataFrame([(1, 3, 1), (2, 6, 9)], "product_id int, months int, feature_id int")
    staged = spark.createDataFrame([(1, "new", "web")], "trx_id int, sub_type string, source_label string")
    found = billing.card_transactions(trx, users, methods, details, orders, products, staged, day(1))
    assert rows(found, "trx_id", "amount_key", "card_type", "months", "days", "source_label") == [(1, 12, "Visa", 3, 90, "web"), (2, 20, "Visa", 3, 30, None)]
    failed = billing.payment_failures(found, "ts", ["months", "card_type"], "status", "login_disabled")
    assert rows(failed, "total", "failed") == [(2, 1)]


def test_package_months(spark, rows):
    df = spark.createDataFrame([(d,) for d in (1, 30, 31, 100, 101, 200, 201, None)], "d int")
    assert [r.m for r in df.select(package_months(df.d).alias("m")).collect()] == [1, 1, 3, 3, 6, 6, 12, None]


def test_slow_components_in_whole_numbers(spark, rows):
    """By default the share is a whole-number ratio, so only pages that are all database count."""
    pages = [("a", 6000, 6000, 5000 + k % 2) for k in range(400)] + [("b", 6000, 5900, 5000 + k % 2) for k in range(400)]
    pages += [("c", 4999, 4999, 4999 + k % 2) for k in range(400)] + [("d", 6000, 6000, 5000)] * 300
    df = spark.createDataFrame(pages, "component string, total int, share int, own int")
    found = monitoring.slow_components(df, ["component"], "total", "share", "own")
    assert rows(found, "component", "occurrences", "average_seconds") == [("a", 400, Decimal("5.001"))]
    decimal = monitoring.slow_components(df.withColumn("share", df.share.cast("double")), ["component"], "total", "share", "own")
    assert [r.component for r in decimal.orderBy("component").collect()] == ["a", "b"]


def test_stored_funnel_keeps_its_schema(spark, tmp_path):
    schema = schemas.ONBOARDING_FUNNEL
    row = {f.name: ("x" if f.name == "cohort" else 1) for f in schema}
    summaries.write_summary(spark.createDataFrame([row]), str(tmp_path / "s"), schema)
    assert summaries.read_summary(spark, str(tmp_path / "s"), schema).schema == schema
