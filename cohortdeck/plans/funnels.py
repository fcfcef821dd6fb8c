"""Conversion and onboarding funnels and the step funnel of an import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.numbers import money, safe_rate
from cohortdeck.functions.times import Moment, shift
from cohortdeck.operators.aggregates import count_when
from cohortdeck.operators.filters import between_moments
from cohortdeck.operators.joins import with_keys, without_keys
from cohortdeck.sources.bucketed import deal_out


def package_flags(
    months: str = "months",
    bundled: str = "is_bundled",
    product: str = "product_id",
    upsell: Mapping[int, int] = fixed.UPSELL_PRODUCTS,
) -> dict[str, Column]:
    """The package mix: single month, then each length plain, bundled and upsold."""
    flags = {"pkg_1": F.col(months) == 1}
    for length in fixed.PACKAGE_MONTHS:
        of_length = F.col(months) == length
        in_bundle = of_length & (F.col(bundled) == 1)
        flags[f"pkg_{length}"] = of_length & (F.col(bundled) == 0)
        flags[f"pkg_{length}_bundle"] = in_bundle & (F.col(product) != upsell[length])
        flags[f"pkg_{length}_upsell"] = in_bundle & (F.col(product) == upsell[length])
    return flags


def first_views(
    views: DataFrame, user: str, ts: str, population: DataFrame | None = None, after: Column | None = None
) -> DataFrame:
    """Each user's first view, optionally only of a population and after a bound.

    ``after`` may use the population's columns, e.g. a bound chosen by a flag; a
    null bound lets nothing through.
    """
    if after is None:
        firsts = views.groupBy(user).agg(F.min(ts).alias(ts))
        return firsts if population is None else with_keys(firsts, population, [user])
    rows = views if population is None else views.join(population, [user])
    return rows.filter(F.col(ts) > after).groupBy(user).agg(F.min(ts).alias(ts))


def without_prior_purchase(viewers: DataFrame, user: str, purchases: DataFrame, ts: str, before: Moment) -> DataFrame:
    """Viewers who bought nothing before the test started."""
    return without_keys(viewers, between_moments(purchases, ts, None, before), [user])


class FunnelTables(NamedTuple):
    """The funnel's inputs, each reduced to what its keys need."""

    sessions: DataFrame
    firsts: DataFrame
    transactions: DataFrame
    payments: DataFrame
    gone: DataFrame


def funnel_tables(
    viewers: DataFrame, payment_views: DataFrame, transactions: DataFrame, cash: DataFrame, resigned: DataFrame, dims: Sequence[str]
) -> FunnelTables:
    """Sessions and payments shrink to their key before they are joined, so they never multiply each other."""
    keys = ["user_id", "session_id"]
    amount = money(F.coalesce(F.col("amount"), F.lit(0)))
    return FunnelTables(
        viewers.select(*keys, *dims).distinct(),
        payment_views.groupBy(*keys).agg(F.min("ts").alias("_first_view")),
        transactions.distinct(),
        cash.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("_payments"), F.sum(amount).alias("_cash"), F.sum(amount * amount).alias("_squares")
        ),
        resigned.select("user_id").distinct().withColumn("_gone", F.lit(1)),
    )


def dealt_funnel_tables(tables: FunnelTables, buckets: int) -> FunnelTables:
    """The same, stored in buckets by user: funnels of any dims and packages start from them without a shuffle.

    Only one row a session and what was really bought is left of a busy user, so a flood of
    views doesn't fill a bucket.
    """
    return FunnelTables(*[deal_out(df, f"funnel-{name}", "user_id", buckets) for name, df in tables._asdict().items()])


def funnel_users(tables: FunnelTables, dims: Sequence[str], packages: Mapping[str, Column]) -> DataFrame:
    """One row per cohort and viewer: payment page seen, transactions, cash, resigned.

    Transactions meet the sessions in an inner join, which Spark can split when one
    session holds much of them, and are summed per user at once.
    """
    keys = ["user_id", "session_id"]
    seen = tables.sessions.join(tables.firsts, keys, "left")
    bought = (
        tables.transactions.join(seen.filter(F.col("_first_view").isNotNull()), keys)
        .filter(F.col("_first_view") < F.col("ts"))
        .groupBy(*dims, "user_id")
        .agg(
            F.count(F.lit(1)).alias("_trx"),
            *[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in packages.items()],
        )
    )
    users = (
        seen.filter(F.col("user_id").isNotNull())
        .groupBy(*dims, "user_id")
        .agg(F.max(F.when(F.col("_first_view").isNotNull(), 1).otherwise(0)).alias("_paying"))
        .join(bought, [*dims, "user_id"], "left")
    )
    return users.join(tables.payments, ["user_id"], "left").join(tables.gone, ["user_id"], "left")


def _funnel_counts(users: DataFrame, dims: Sequence[str], packages: Mapping[str, Column], fanout: str) -> DataFrame:
    if fanout not in ("reference", "per_user"):
        raise ValueError("fanout is 'reference' or 'per_user'")
    is_sub = (F.col("_trx") > 0) & (F.col("_payments") > 0)
    times = F.col("_trx") if fanout == "reference" else F.lit(1)
    gone_times = times * F.col("_payments") if fanout == "reference" else F.lit(1)
    return users.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("viewers"),
        F.sum("_paying").alias("payment_viewers"),
        F.count_if(is_sub).alias("subs"),
        F.sum(F.when(is_sub, F.col("_cash") * times)).cast("decimal(28,2)").alias("total_cash"),
        F.sum(F.when(is_sub, F.col("_squares") * times)).cast("decimal(38,4)").alias("sum_square_cash"),
        *[F.sum(F.when(is_sub, F.col(name)).otherwise(0)).alias(name) for name in packages],
        F.sum(F.when(is_sub & (F.col("_gone") == 1), gone_times).otherwise(0)).alias("resignations"),
    )


def trx_summary(
    viewers: DataFrame,
    payment_views: DataFrame,
    transactions: DataFrame,
    cash: DataFrame,
    resigned: DataFrame,
    dims: Sequence[str] = ("cohort",),
    packages: Mapping[str, Column] | None = None,
    fanout: str = "reference",
) -> DataFrame:
    """Subscribers, cash, sum of squares, package mix and resignations per cohort.

    Inputs and ``fanout`` as in ``conversion_funnel``; cohorts without subscribers are
    left out.
    """
    packages = package_flags() if packages is None else packages
    known = viewers.dropna(subset=list(dims))
    users = funnel_users(funnel_tables(known, payment_views, transactions, cash, resigned, dims), dims, packages)
    counts = _funnel_counts(users, dims, packages, fanout).filter(F.col("subs") > 0)
    return counts.drop("viewers", "payment_viewers")


def conversion_funnel(
    viewers: DataFrame,
    payment_views: DataFrame,
    transactions: DataFrame,
    cash: DataFrame,
    resigned: DataFrame,
    dims: Sequence[str] = ("cohort",),
    fanout: str = "reference",
) -> DataFrame:
    """Offer viewers, payment-page viewers, subscribers, cash and rates per cohort.

    Inputs are already limited to the test's dates and to countable rows:
    ``viewers`` (user_id, session_id, dims), ``payment_views`` (user_id, session_id,
    ts), ``transactions`` (user_id, session_id, ts, ...), ``cash`` with every successful
    payment (user_id, amount) and ``resigned`` (user_id).  A transaction counts when its
    session saw the payment page earlier.  Cohorts that are null are left out.

    ``fanout="reference"`` counts a user's cash and resignation once per pair of
    transaction and payment, as joining the three sets does; ``"per_user"`` counts them
    once.  The pairs are multiplied out, not formed.
    """
    known = viewers.dropna(subset=list(dims))
    users = funnel_users(funnel_tables(known, payment_views, transactions, cash, resigned, dims), dims, {})
    return funnel_rates(_funnel_counts(users, dims, {}, fanout), dims)


def funnel_of(tables: FunnelTables, dims: Sequence[str] = ("cohort",), fanout: str = "reference") -> DataFrame:
    """``conversion_funnel`` from stored tables; ``dims`` may be some of theirs."""
    sessions = tables.sessions.dropna(subset=list(dims)).select("user_id", "session_id", *dims).distinct()
    users = funnel_users(tables._replace(sessions=sessions), dims, {})
    return funnel_rates(_funnel_counts(users, dims, {}, fanout), dims)


def funnel_rates(counts: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rates of the conversion funnel; absent counts and rates over nothing are 0."""
    filled = counts.fillna(0, ["payment_viewers", "subs", "resignations"])
    viewers, paying, subs = F.col("viewers"), F.col("payment_viewers"), F.col("subs")
    cash = F.coalesce(F.col("total_cash"), F.lit(0)).cast("decimal(18,4)")
    return filled.select(
        *dims,
        "viewers",
        "payment_viewers",
        "subs",
        safe_rate(paying, viewers).alias("view_to_payment"),
        safe_rate(subs, paying).alias("payment_to_sub"),
        safe_rate(subs, viewers).alias("view_to_sub"),
        cash.alias("total_cash"),
        safe_rate(cash, subs).alias("arpu"),
        "resignations",
        safe_rate(F.col("resignations"), subs).alias("resign_rate"),
    ).orderBy(*dims)


def onboarding_flags(
    users: DataFrame,
    submissions: DataFrame,
    profiles: DataFrame,
    photos: DataFrame,
    viewers: DataFrame,
    buyers: DataFrame,
    profile_minutes: int = fixed.PROFILE_MINUTES,
    photo_minutes: int = fixed.PHOTO_MINUTES,
) -> DataFrame:
    """One row per user with the onboarding steps reached, as 0 or 1.

    ``users``: user_id, session_id, signup_ts, cohort.  ``submissions``: user_id,
    session_id, submit_ts, approve_ts.  ``profiles``: user_id, create_ts, approve_ts,
    photo_id.  ``photos``: user_id, photo_id, upload_ts.  ``viewers`` and ``buyers``:
    user_id.  A profile counts when made soon after signup; a photo when it is the
    approved profile's and uploaded soon after the submission.  Every step is one
    row per user before it is joined; only a user's pictures may be several.
    """
    submitted = submissions.groupBy("user_id", "session_id").agg(
        F.max("submit_ts").alias("_submit"), F.max("approve_ts").alias("_approve")
    )
    made = profiles.groupBy("user_id").agg(F.min("create_ts").alias("_made"))
    uploads = photos.groupBy("user_id", "photo_id").agg(F.min("upload_ts").alias("_upload"))
    pictures = (
        profiles.filter(F.col("approve_ts").isNotNull() & (F.col("photo_id") > 0))
        .groupBy("user_id", "photo_id")
        .agg(F.min("create_ts").alias("_photo_made"))
        .join(uploads, ["user_id", "photo_id"])
    )
    flags = (
        users.join(submitted, ["user_id", "session_id"], "left")
        .join(made, ["user_id"], "left")
        .join(viewers.select("user_id").distinct().withColumn("_viewer", F.lit(1)), ["user_id"], "left")
        .join(buyers.select("user_id").distinct().withColumn("_buyer", F.lit(1)), ["user_id"], "left")
        .join(pictures, ["user_id"], "left")
    )
    in_time = shift(F.col("signup_ts"), profile_minutes, "MINUTE")
    photo_ok = (F.col("_photo_made") < in_time) & (
        F.col("_upload") <= shift(F.col("_submit"), photo_minutes, "MINUTE")
    )
    steps = {
        "created": F.col("_made") < in_time,
        "submitted": F.col("_submit").isNotNull(),
        "approved": F.col("_approve").isNotNull(),
        "photo_approved": photo_ok,
        "viewers": F.col("_viewer") == 1,
        "subs": F.col("_buyer") == 1,
    }
    return flags.groupBy("cohort", "user_id").agg(
        *[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in steps.items()]
    )


def onboarding_funnel(*inputs: DataFrame, **limits: int) -> DataFrame:
    """Users, steps reached and rates per cohort (inputs as in ``onboarding_flags``).

    Cohorts nobody of which saw an offer are left out.
    """
    flags = onboarding_flags(*inputs, **limits)
    steps = ("created", "submitted", "approved", "photo_approved", "viewers", "subs")
    counts = flags.groupBy("cohort").agg(
        F.count("user_id").alias("users"), *[F.sum(step).alias(step) for step in steps]
    )
    rates = {
        "created_rate": ("created", "users"),
        "submitted_rate": ("submitted", "users"),
        "approved_rate": ("approved", "users"),
        "photo_approved_rate": ("photo_approved", "users"),
        "viewer_rate": ("viewers", "users"),
        "subs_rate": ("subs", "users"),
        "subs_per_viewer": ("subs", "viewers"),
    }
    return (
        counts.filter(F.col("viewers") > 0)
        .select(
            "cohort",
            "users",
            *steps,
            *[safe_rate(F.col(a), F.col(b)).alias(name) for name, (a, b) in rates.items()],
        )
        .orderBy("cohort")
    )


def step_funnel(
    requests: DataFrame, statuses: DataFrame, site: str, steps: Mapping[str, int], success: int = 3
) -> DataFrame:
    """Per site: requests with a successful step, and those that got to each step.

    ``requests``: request_id and the site; ``statuses``: request_id, step, status.
    ``steps`` maps result columns to step numbers.
    """
    reached = statuses.filter(F.col("status") == success).groupBy("request_id").agg(F.max("step").alias("step"))
    return (
        requests.join(reached, ["request_id"])
        .groupBy(site)
        .agg(
            F.count(F.lit(1)).alias("daily_total"),
            *[count_when(F.col("step") >= number).alias(name) for name, number in steps.items()],
        )
    )


def error_counts(requests: DataFrame, statuses: DataFrame, failed: int = 4) -> DataFrame:
    """Failed steps of the requests by message, most frequent first."""
    errors = statuses.filter(F.col("status") == failed).groupBy("request_id", "message").agg(F.count(F.lit(1)).alias("_n"))
    return (
        errors.join(requests.select("request_id"), ["request_id"])
        .groupBy("message")
        .agg(F.sum("_n").alias("errors"))
        .orderBy(F.col("errors").desc(), "message")
    )
