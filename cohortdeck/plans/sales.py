"""Sales of add-on features: calendars, revenue, price points, buyers, lapses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.labels import code_label, cohort_digit, digit_cohort
from cohortdeck.functions.numbers import int_div, money, nullable_rate
from cohortdeck.functions.texts import id_shards, joined_text
from cohortdeck.functions.times import Moment, age_in_years, calendar_day, midnight, shift, shift_days
from cohortdeck.operators.aggregates import count_when, top_rows
from cohortdeck.operators.calendars import day_spine, fill_days
from cohortdeck.operators.filters import between_moments
from cohortdeck.operators.timeline import covering_count, interval_counts


def _first_timers(sales: DataFrame, user: str, ts: str) -> DataFrame:
    firsts = sales.groupBy(user).agg(F.min(F.to_date(ts)).alias("purchase_date"))
    return firsts.groupBy("purchase_date").agg(F.count(user).alias("new_users"))


def _with_rates(daily: DataFrame) -> DataFrame:
    bought = F.col("purchases").cast("decimal(18,2)")
    return daily.withColumn(
        "rate_today", nullable_rate(bought, F.col("buyers")).cast("decimal(28,3)")
    ).withColumn("rate_new", nullable_rate(bought, F.col("new_users")).cast("decimal(28,3)"))


def sales_calendar(
    sales: DataFrame,
    sale_id: str,
    user: str,
    ts: str,
    start: Moment,
    as_of: Moment,
    first_sales: DataFrame | None = None,
) -> DataFrame:
    """Purchases, distinct buyers, first-time buyers and rates for every day.

    Days run from ``start`` to the day before ``as_of``; empty days show zeros and
    null rates.  A buyer's first day is sought in ``first_sales`` (default: all of
    ``sales``, also before ``start``).
    """
    in_range = between_moments(sales, ts, midnight(start), midnight(as_of))
    per_user = in_range.groupBy(F.to_date(ts).alias("purchase_date"), user).agg(F.count(sale_id).alias("_n"))
    daily = per_user.groupBy("purchase_date").agg(F.sum("_n").alias("purchases"), F.count(user).alias("buyers"))
    firsts = _first_timers(sales if first_sales is None else first_sales, user, ts)
    filled = fill_days(
        daily.join(firsts, ["purchase_date"], "full"),
        "purchase_date",
        start,
        shift_days(as_of, -1),
        ("purchases", "buyers", "new_users"),
    )
    return _with_rates(filled).orderBy("purchase_date")


def sales_calendar_by_group(
    sales: DataFrame,
    sale_id: str,
    user: str,
    ts: str,
    groups: DataFrame,
    group: str,
    start: Moment,
    as_of: Moment,
    keep_zero_days: bool = False,
) -> DataFrame:
    """The calendar per group of buyers.  First-time buyers are those of all groups.

    Days on which no group bought are absent unless ``keep_zero_days``.
    """
    in_range = between_moments(sales, ts, midnight(start), midnight(as_of))
    per_user = in_range.groupBy(F.to_date(ts).alias("purchase_date"), user).agg(F.count(sale_id).alias("_n"))
    daily = (
        per_user.join(groups.select(user, group), [user])
        .groupBy("purchase_date", group)
        .agg(F.sum("_n").alias("purchases"), F.count_distinct(user).alias("buyers"))
    )
    if keep_zero_days:
        daily = fill_days(daily, "purchase_date", start, shift_days(as_of, -1), ("purchases", "buyers"))
    joined = daily.join(_first_timers(sales, user, ts), ["purchase_date"], "left").fillna(0, ["new_users"])
    return _with_rates(joined).orderBy("purchase_date", group)


def sales_by_validity(
    sales: DataFrame,
    user: str,
    ts: str,
    validity: DataFrame,
    begin: str,
    end: str,
    start: Moment,
    as_of: Moment,
    labels: tuple[str, str] = ("Sub", "Non-Sub"),
) -> DataFrame:
    """Distinct buyers per day and whether a validity interval held at the purchase."""
    in_range = between_moments(sales, ts, midnight(start), midnight(as_of))
    covered = covering_count(in_range.select(user, ts), ts, validity.select(user, begin, end), begin, end, [user], "_held")
    state = F.when(F.col("_held") > 0, labels[0]).otherwise(labels[1])
    daily = covered.groupBy(F.to_date(ts).alias("purchase_date"), state.alias("state")).agg(
        F.count_distinct(user).alias("buyers")
    )
    spine = day_spine(sales.sparkSession, start, shift_days(as_of, -1), "purchase_date")
    return spine.join(daily, ["purchase_date"], "left").fillna(0, ["buyers"]).orderBy("purchase_date", "state")


def billing_chain(
    trx: DataFrame,
    trx_details: DataFrame,
    account_details: DataFrame,
    orders: DataFrame,
    product_details: DataFrame,
    products: DataFrame,
    features: Sequence[int],
    trx_types: Sequence[int],
    statuses: Sequence[int] = (1,),
    categories: Sequence[int] = (1, 4),
    start: Moment | None = None,
) -> DataFrame:
    """Transactions along the billing chain to a product feature: the input of ``revenue``.

    ``trx``: trx_id, user_id, ts, amount, trx_type, status, category.  ``trx_details``: trx_id,
    account_detail_id.  ``account_details``: account_detail_id, order_id, product_detail_id.
    ``orders``: order_id.  ``product_details``: product_detail_id, product_id.  ``products``:
    product_id, feature_id.  A transaction has a row, with its whole amount, per detail that
    leads to a product of the features.  The product side shrinks to its ids first, and
    transactions are filtered at their scan; other columns of ``trx`` are handed on.
    """
    wanted = between_moments(trx, "ts", start, None).filter(
        F.col("trx_type").isin(*trx_types) & F.col("status").isin(*statuses) & F.col("category").isin(*categories)
    )
    sold = products.filter(F.col("feature_id").isin(*features)).select("product_id")
    wares = product_details.select("product_detail_id", "product_id").join(sold, ["product_id"]).select("product_detail_id")
    booked = (
        account_details.select("account_detail_id", "order_id", "product_detail_id")
        .join(wares, ["product_detail_id"])
        .join(orders.select("order_id"), ["order_id"])
        .select("account_detail_id")
    )
    lines = trx_details.select("trx_id", "account_detail_id").join(booked, ["account_detail_id"]).select("trx_id")
    return wanted.join(lines, ["trx_id"])


def revenue(
    lines: DataFrame, amount: str, ts: str, filters: Sequence[Column] = (), start: Moment | None = None, by_day: bool = False
) -> DataFrame:
    """Revenue and order lines of a joined billing chain, in total or per day."""
    rows = between_moments(lines, ts, start, None)
    for test in filters:
        rows = rows.filter(test)
    measures = [F.sum(money(F.col(amount))).alias("revenue"), F.count(F.lit(1)).alias("line_count")]
    if not by_day:
        return rows.agg(*measures)
    return rows.groupBy(F.to_date(ts).alias("metric_date")).agg(*measures).orderBy("metric_date")


def price_point_daily(
    trx: DataFrame,
    user: str,
    ts: str,
    amount: str,
    users: DataFrame,
    guid: str,
    position: int = 7,
    cohorts: Mapping[str, str] = fixed.PRICE_POINTS,
) -> DataFrame:
    """Buyers, revenue and revenue per buyer by day and price cohort.

    A user's day is summed before the cohort lookup, so users join once per day.
    """
    per_user = trx.groupBy(F.to_date(ts).alias("purchase_date"), user).agg(F.sum(money(F.col(amount))).alias("_cash"))
    cohort = digit_cohort(cohort_digit(F.col(guid), position), cohorts)
    daily = (
        per_user.join(users.select(user, guid), [user])
        .groupBy("purchase_date", cohort.alias("cohort"))
        .agg(F.count_distinct(user).alias("users"), F.sum("_cash").alias("revenue"))
    )
    per_buyer = F.try_divide(F.col("revenue"), F.col("users")).cast("decimal(18,4)")
    return daily.withColumn("arpu", per_buyer).orderBy("purchase_date", "cohort")


def impressions_per_buyer(
    purchases: DataFrame,
    purchase_id: str,
    user: str,
    begin: str,
    end: str,
    impressions: DataFrame,
    impression_user: str,
    impression_ts: str,
    count_matches: bool = False,
    grain: str = "hour",
) -> DataFrame:
    """Impressions inside each purchase's interval, per purchase day.

    By default a purchase without impressions counts as 1, as counting the rows of
    a left join does; ``count_matches`` counts 0.
    """
    bought = purchases.select(user, purchase_id, begin, end)
    found = interval_counts(
        bought,
        [purchase_id, begin],
        F.col(begin),
        F.col(end),
        impressions.select(F.col(impression_user).alias(user), impression_ts),
        impression_ts,
        [user],
        "_n",
        grain=grain,
    )
    counted = F.col("_n") if count_matches else F.greatest(F.col("_n"), F.lit(1))
    daily = found.groupBy(F.to_date(begin).alias("start_date")).agg(
        F.count(purchase_id).alias("buyers"), F.sum(counted).alias("impressions")
    )
    return daily.withColumn("per_buyer", int_div(F.col("impressions"), F.col("buyers"))).orderBy("start_date")


def lapse_contact(
    lapses: DataFrame,
    user: str,
    lapse_date: str,
    contacts: DataFrame,
    contact_user: str,
    contact_ts: str,
    days: int = 7,
    distinct_users: bool = False,
) -> DataFrame:
    """Per lapse date: lapsed users never contacted since ``days`` before, and contacts.

    ``has_contact`` counts contacts (a user contacted twice counts twice) unless
    ``distinct_users``.  The look-back has no upper bound.
    """
    per_lapse = lapses.groupBy(user, lapse_date).agg(F.count(F.lit(1)).alias("_rows"))
    since = shift(F.col(lapse_date).cast("timestamp_ntz"), -days, "DAY")
    found = interval_counts(
        per_lapse,
        [user, lapse_date, "_rows"],
        since,
        None,
        contacts.select(F.col(contact_user).alias(user), contact_ts),
        contact_ts,
        [user],
        "_n",
    )
    none, weight = F.col("_n") == 0, F.lit(1) if distinct_users else F.col("_n")
    return (
        found.groupBy(lapse_date)
        .agg(
            F.sum(F.when(none, F.col("_rows")).otherwise(0)).alias("no_contact"),
            F.sum(F.when(~none, F.col("_rows") * weight).otherwise(0)).alias("has_contact"),
        )
        .orderBy(lapse_date)
    )


def redemption(grants: DataFrame, user: str, begin: str, members: DataFrame, last_login: str, active_since: Moment) -> DataFrame:
    """Of the granted rows of test members: redeemed, not redeemed, member inactive."""
    per_user = grants.groupBy(user).agg(
        F.count(begin).alias("_redeemed"), F.count(F.lit(1)).alias("_rows")
    )
    active = F.col(last_login) >= calendar_day(active_since)
    rows = per_user.join(members.select(user, last_login), [user])
    return rows.agg(
        F.sum(F.when(active, F.col("_redeemed")).otherwise(0)).alias("redeemed"),
        F.sum(F.when(active, F.col("_rows") - F.col("_redeemed")).otherwise(0)).alias("not_redeemed"),
        F.sum(F.when(~active, F.col("_rows")).otherwise(0)).alias("not_active"),
    )


def search_impressions(log: DataFrame, ts: str, keys: Sequence[str], shown: str, flag: Column) -> DataFrame:
    """Distinct shown users and flagged rows per day and search."""
    return log.groupBy(F.to_date(ts).alias("metric_date"), *keys).agg(
        F.count_distinct(shown).alias("impressions"), count_when(flag).alias("flagged")
    )


def top_buyers(
    log: DataFrame,
    user: str,
    users: DataFrame,
    places: DataFrame,
    place_keys: Sequence[str],
    place_names: Sequence[str],
    as_of: Moment,
    n: int = 100,
    picture_root: str = "",
    profile_root: str = "",
) -> DataFrame:
    """The users with most purchases, with profile and place.

    ``users`` has ``handle``, ``birthday``, ``seeking``, ``photo`` (a letter) and the
    place keys.  Ties are broken by user id.  Users without a profile are out before
    the cut, users without a known place after it.
    """
    counts = log.groupBy(user).agg(F.count(F.lit(1)).alias("purchases"))
    best = top_rows(counts.join(users, [user]), n, "purchases", [user])
    first_dir, second_dir = id_shards(F.col(user))
    found = best.join(places.select(*place_keys, *place_names), list(place_keys))
    return found.select(
        user,
        "handle",
        age_in_years(F.col("birthday"), calendar_day(as_of)).alias("age"),
        code_label(F.col("seeking"), fixed.SEEKING).alias("seeking_label"),
        *place_names,
        joined_text(
            picture_root, first_dir, "/", second_dir, "/", F.col(user).cast("string"), F.col("photo"), ".jpg"
        ).alias("image_path"),
        joined_text(profile_root, F.col("handle")).alias("profile_path"),
        "purchases",
    ).orderBy(F.col("purchases").desc(), user)
