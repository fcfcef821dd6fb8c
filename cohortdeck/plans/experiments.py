"""Comparing test cohorts: price tests, message tests, stored summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.functions.labels import code_label
from cohortdeck.functions.numbers import lift_percent, money, percent
from cohortdeck.operators.sets import append


def price_test_buyers(sales: DataFrame, dims: Sequence[str], split: Sequence[str] = ()) -> DataFrame:
    """First transaction per buyer and cohort: its time and its amount.

    ``sales``: user_id, trx_id, ts, amount and the cohort columns ``dims``.  ``split``
    columns are grouped by too, giving a user one row per value of them.  The first
    time and the lowest transaction id may be of different rows.
    """
    return sales.groupBy("user_id", *dims, *split).agg(
        F.min("ts").alias("first_ts"), F.min_by(money(F.col("amount")), F.col("trx_id")).alias("first_amount")
    )


def price_test_summary(buyers: DataFrame, trx: DataFrame, resigned: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Buyers, total, initial and renewal cash and resignations per cohort.

    ``buyers`` as made by ``price_test_buyers``; ``trx`` holds successful payments
    (user_id, ts, amount, is_renewal, and is_cash for those that count as cash).  Cash
    counts from the buyer row's first time on; a user with several buyer rows counts
    once per row.  Only cohorts with all four measures appear.
    """
    gone = resigned.select("user_id").distinct().withColumn("_gone", F.lit(1))
    counted = buyers.groupBy("user_id", "first_ts", *dims).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("first_amount").alias("_first")
    )
    cash = trx.filter("is_cash").groupBy("user_id", F.col("ts").alias("_ts")).agg(
        F.sum(money(F.col("amount"))).alias("_sum"),
        F.sum(F.when(F.col("is_renewal"), money(F.col("amount")))).alias("_renewal_sum"),
        F.count_if("is_renewal").alias("_renewals"),
    )
    # A user has few buyer rows, so payments meet them directly and late ones are added up.
    late = F.col("_ts") >= F.col("first_ts")
    per_row = (
        counted.join(cash, ["user_id"], "left")
        .groupBy("user_id", "first_ts", "_rows", "_first", *dims)
        .agg(
            F.sum(F.when(late, F.col("_sum"))).alias("_cash"),
            F.max(late).alias("_paid"),
            F.sum(F.when(late, F.col("_renewal_sum"))).alias("_renewal"),
            F.max(late & (F.col("_renewals") > 0)).alias("_renewed"),
        )
    )
    rows = F.col("_rows")
    per_user = (
        per_row.groupBy("user_id", *dims)
        .agg(
            F.max("_paid").alias("_paid"),
            F.sum(F.when(F.col("_paid"), F.coalesce("_cash", F.lit(0)) * rows)).alias("_cash"),
            F.sum("_first").alias("_first"),
            F.sum(F.when(F.col("_renewed"), F.coalesce("_renewal", F.lit(0)) * rows)).alias("_renewal"),
        )
        .join(gone, ["user_id"], "left")
    )
    known = F.col("user_id").isNotNull()
    totals = per_user.groupBy(*dims).agg(
        F.count_if(F.col("_paid") & known).alias("users"),
        F.sum("_cash").cast("decimal(28,2)").alias("total_cash"),
        F.sum("_first").cast("decimal(28,2)").alias("initial_cash"),
        F.sum("_renewal").cast("decimal(28,2)").alias("renewal_cash"),
        F.count_if((F.col("_gone") == 1) & known).alias("resignations"),
    )
    return totals.filter(
        (F.col("users") > 0)
        & F.col("initial_cash").isNotNull()
        & F.col("renewal_cash").isNotNull()
        & (F.col("resignations") > 0)
    )


def index_to_control(
    summary: DataFrame,
    cohort: str,
    control: object,
    measures: Mapping[str, int],
    factor: str = "0.75",
    within: Sequence[str] = (),
    conversion_of: str | None = None,
) -> DataFrame:
    """Scale the control to the test cohorts' size and compare with it.

    ``measures`` maps columns to the decimals kept in ``<column>_indexed``.  With
    ``conversion_of`` the lift of that measure over the scaled control of the same
    ``within`` group is added in percent (0 for the control).
    """
    is_control = F.col(cohort) == control
    part = F.lit(factor).cast("decimal(10,5)")

    def scaled(name: str, places: int) -> Column:
        value = F.col(name).cast("decimal(24,4)")
        return F.round(F.when(is_control, value * part).otherwise(value), places).cast(f"decimal(36,{places})")

    indexed = summary.select("*", *[scaled(m, p).alias(f"{m}_indexed") for m, p in measures.items()])
    if conversion_of is None:
        return indexed
    # the summary has one row per cohort, so this window holds a handful of rows
    base = F.sum(F.when(is_control, F.col(conversion_of).cast("decimal(24,4)") * part))
    control_size = base.over(Window.partitionBy(*within)).cast("decimal(28,2)")
    indexed = indexed.withColumn("_control", control_size)
    lift = F.when(is_control, F.lit(0).cast("decimal(36,2)")).otherwise(
        lift_percent(F.col(conversion_of), F.col("_control"))
    )
    return indexed.withColumn("conversion", lift).drop("_control")


def price_test_lift(
    sales: DataFrame,
    trx: DataFrame,
    resigned: DataFrame,
    cohort: str,
    group: str,
    control: object,
    split: Sequence[str] = (),
    factor: str = "0.75",
) -> DataFrame:
    """The whole price test: buyers, their cash, the scaled control and the lift."""
    dims = [cohort, group]
    summary = price_test_summary(price_test_buyers(sales, dims, split), trx, resigned, dims)
    return index_to_control(
        summary,
        cohort,
        control,
        {"users": 0, "total_cash": 2, "initial_cash": 2, "renewal_cash": 2, "resignations": 0},
        factor,
        [group],
        "users",
    ).orderBy(group, cohort)


def message_test(
    users: DataFrame,
    messages: DataFrame,
    buyers: DataFrame,
) -> DataFrame:
    """Sent, first contacts, conversations, subscribers and conversion per cohort.

    ``users``: user_id, cohort.  ``messages``: message_id, sender_id, recipient_id,
    is_response.  ``buyers``: user_id.  Cohorts without messages or subscribers are
    left out.
    """
    initial = F.col("is_response") == 0

    def fact(kind: str, unit: str, first: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col(unit).cast("string").alias("unit"), F.when(first, 1).otherwise(0).alias("first")
        )

    sent = messages.select(
        F.col("sender_id").alias("user_id"),
        F.explode(F.array(fact("sent", "message_id", initial), fact("met", "recipient_id", initial))).alias("f"),
    )
    others = [
        rows.select("user_id", fact(kind, "user_id", F.lit(True)).alias("f"))
        for kind, rows in (("member", users), ("bought", buyers))
    ]
    # one row per user and unit, then one per cohort and unit, then counts
    facts = append(sent, *others).groupBy("user_id", "f.kind", "f.unit").agg(F.max("f.first").alias("first"))
    units = (
        facts.join(users.select("user_id", "cohort").distinct(), ["user_id"])
        .groupBy("cohort", "kind", "unit")
        .agg(F.max("first").alias("first"))
    )
    known, first = F.col("unit").isNotNull(), F.col("first") == 1
    counts = units.groupBy("cohort").agg(
        F.count_if((F.col("kind") == "member") & known).alias("users"),
        F.count_if((F.col("kind") == "sent") & known).alias("sent"),
        F.count_if((F.col("kind") == "sent") & known & first).alias("initial_contacts"),
        F.count_if((F.col("kind") == "met") & known & first).alias("conversations"),
        F.count_if((F.col("kind") == "bought") & known).alias("subs"),
    )
    subs = F.col("subs").cast("decimal(28,2)")
    return (
        counts.filter((F.col("sent") > 0) & (F.col("subs") > 0))
        .select(
            "cohort",
            "users",
            "sent",
            "initial_contacts",
            "conversations",
            "subs",
            F.try_divide(subs, F.col("users")).cast("decimal(18,6)").alias("conversion"),
            F.try_divide(subs, F.col("conversations")).cast("decimal(18,6)").alias("subs_per_conversation"),
            F.try_divide(subs, F.col("sent")).cast("decimal(18,6)").alias("subs_per_message"),
        )
        .orderBy("cohort")
    )


def scaled_cohort_rates(
    parts: Sequence[DataFrame],
    cohort: str,
    factors: Mapping[str, str],
    scaled: Mapping[str, int],
    summed: Sequence[str] = (),
    rates: Mapping[str, tuple[str, str]] | None = None,
    default_factor: str = "1",
) -> DataFrame:
    """Stored cohort rows re-scaled to one size, added up, with percentage rates.

    ``factors`` gives the multiplier of each cohort, ``default_factor`` that of the
    others; ``scaled`` maps the columns it applies to onto their decimals.  ``summed``
    columns are added as they are.  ``rates`` are computed from the sums.
    """
    rows = append(*parts)
    factor = code_label(F.col(cohort), dict(factors), default_factor).cast("decimal(10,4)")
    cells = [
        (F.col(name).cast("decimal(18,4)") * factor).cast(f"decimal(20,{places})").alias(name)
        for name, places in scaled.items()
    ]
    totals = rows.select(cohort, *summed, *cells).groupBy(cohort).agg(
        *[F.sum(name).alias(name) for name in [*summed, *scaled]]
    )
    shares = [percent(F.col(a), F.col(b)).alias(name) for name, (a, b) in (rates or {}).items()]
    return totals.select("*", *shares).orderBy(cohort)
