"""Billing: failed payments, coded card updates, operational listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.labels import code_label, first_match
from cohortdeck.functions.times import Moment, midnight, shift
from cohortdeck.operators.aggregates import count_when
from cohortdeck.operators.filters import between_moments, rolling_window, same_day


def payment_failures(
    trx: DataFrame, ts: str, dims: Sequence[str], status: str, login: str, start: Moment | None = None
) -> DataFrame:
    """Attempts and failures per day, ``dims`` and whether the account is disabled."""
    disabled = F.when(~F.col(login).isin(*fixed.DISABLED_LOGINS), 0).otherwise(1)
    rows = between_moments(trx, ts, start, None)
    return (
        rows.groupBy(F.to_date(ts).alias("day"), *dims, disabled.alias("login_disabled"))
        .agg(
            count_when(F.col(status).isin(fixed.STATUS_SUCCESS, fixed.STATUS_FAILED)).alias("total"),
            count_when(F.col(status) == fixed.STATUS_FAILED).alias("failed"),
        )
        .orderBy("day", *dims, "login_disabled")
    )


def completion_label(code: Column) -> Column:
    """Outcome text of a card update; negative codes are exceptions."""
    return first_match(
        [(code == key, label) for key, label in fixed.CARD_COMPLETION.items()]
        + [(code < 0, fixed.CARD_EXCEPTION)],
        "Unknown",
    )


def coded_outcomes(
    updates: DataFrame,
    ts: str,
    as_of: Moment,
    division: str,
    divisions: Mapping,
    response: str,
    completion: str,
    months: int = 6,
    filters: Sequence[Column] = (),
) -> DataFrame:
    """Daily card updates by division, response and outcome, decoded.

    Codes are counted before they are decoded; equal labels are then added up.
    """
    rows = between_moments(updates, ts, midnight(shift(as_of, -months, "MONTH")), None)
    for test in filters:
        rows = rows.filter(test)
    counts = rows.groupBy(F.to_date(ts).alias("update_date"), division, response, completion).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        counts.groupBy(
            "update_date",
            code_label(F.col(division), divisions, "Unknown").alias("division_label"),
            code_label(F.col(response), fixed.CARD_RESPONSES, "Unknown").alias("response_label"),
            completion_label(F.col(completion)).alias("completion_label"),
        )
        .agg(F.sum("_n").alias("cards"))
        .orderBy("update_date", "division_label", "response_label", "completion_label")
    )


def recent_listing(
    rows: DataFrame,
    ts: str,
    as_of: Moment,
    columns: Sequence[str],
    minutes: int | None = None,
    filters: Sequence[Column] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Plain rows of today (or of the last ``minutes``) passing the filters."""
    found = same_day(rows, ts, as_of) if minutes is None else rolling_window(rows, ts, as_of, minutes)
    for test in filters:
        found = found.filter(test)
    listed = found.select(*columns)
    return listed.orderBy(*order) if order else listed


def card_transactions(
    trx: DataFrame,
    users: DataFrame,
    methods: DataFrame,
    details: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    staged: DataFrame | None = None,
    start: Moment | None = None,
    feature: int = 1,
    category: int = 1,
    trx_type: int = 1,
) -> DataFrame:
    """New-sale transactions with their card, package, order and source: the input of ``payment_failures``.

    ``trx``: trx_id, user_id, ts, status, category, trx_type, amount, method_id.  ``users``:
    user_id, login_disabled (those that may count).  ``methods``: method_id, card_type.
    ``details``: trx_id, order_id, product_id, days.  ``orders``: order_id, is_resub.
    ``products``: product_id, months, feature_id.  ``staged``: trx_id, sub_type,
    source_label, which a transaction may lack.  Filters come before the joins, so they
    reach the scans; a transaction has a row per detail whose product is of ``feature``.
    """
    wanted = between_moments(trx, "ts", start, None).filter((F.col("category") == category) & (F.col("trx_type") == trx_type))
    rows = (
        wanted.select("trx_id", "user_id", "ts", "status", F.floor("amount").alias("amount_key"), "method_id")
        .join(users.select("user_id", "login_disabled"), ["user_id"])
        .join(methods.select("method_id", "card_type"), ["method_id"])
        .join(details.select("trx_id", "order_id", "product_id", "days"), ["trx_id"])
        .join(orders.select("order_id", "is_resub"), ["order_id"])
        .join(products.filter(F.col("feature_id") == feature).select("product_id", "months"), ["product_id"])
    )
    if staged is not None:
        rows = rows.join(staged.select("trx_id", "sub_type", "source_label"), ["trx_id"], "left")
    return rows.drop("method_id", "order_id", "product_id")
