"""Conversations: outcomes, status counts, the share started by fraud accounts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.labels import code_label
from cohortdeck.functions.times import Moment
from cohortdeck.operators.baselines import trim_high
from cohortdeck.operators.filters import closed_days
from cohortdeck.operators.joins import with_role


def last_status(alerts: DataFrame, session: str, ignored: Sequence[int] = (5,)) -> DataFrame:
    """Highest status per day, session, sender and recipient."""
    return (
        alerts.filter(~F.col("status").isin(*ignored))
        .groupBy(F.to_date("ts").alias("metric_date"), session, "from_user", "to_user")
        .agg(F.max("status").alias("last_status"))
    )


def conversation_outcomes(
    alerts: DataFrame, users: DataFrame, session: str = "session_id", disabled: Sequence[int] = fixed.DISABLED_LOGINS
) -> DataFrame:
    """Daily senders, recipients and outcomes, for all and without disabled accounts.

    ``alerts``: session, from_user, to_user, status, ts.  ``users``: user_id,
    login_disabled.  Sessions shrink to one row before the two user lookups.
    Outcomes that do not occur are null.
    """
    sessions = last_status(alerts, session)
    roles = with_role(sessions, "from_user", users, "user_id", {"login_disabled": "_from"})
    roles = with_role(roles, "to_user", users, "user_id", {"login_disabled": "_to"})
    status = F.col("last_status")
    from_ok, to_ok = ~F.col("_from").isin(*disabled), ~F.col("_to").isin(*disabled)
    outcomes = {"displayed": (1, 2, 3, 4), "accepted": (2, 4), "rejected": (3,)}
    counted = {"initiated": F.lit(True), "initiated_clean": from_ok}
    for name, codes in outcomes.items():
        counted |= {name: status.isin(*codes), f"{name}_clean": status.isin(*codes) & from_ok}
    # Each session once as its sender's and once as its recipient's; distinct users are then
    # rows of a user with a flag, where the built-in rewrite repeats a row per distinct count.
    nothing = F.lit(None).cast("int")
    sides = F.array(
        F.struct(F.lit(True).alias("sent"), F.col("from_user").alias("user"), from_ok.alias("ok"), *[F.when(test, 1).alias(n) for n, test in counted.items()]),
        F.struct(F.lit(False).alias("sent"), F.col("to_user").alias("user"), to_ok.alias("ok"), *[nothing.alias(n) for n in counted]),
    )
    per_user = (
        roles.select("metric_date", F.explode(sides).alias("_s")).select("metric_date", "_s.*")
        .groupBy("metric_date", "sent", "user").agg(F.max("ok").alias("ok"), *[F.sum(n).alias(n) for n in counted])
    )
    known, sent, clean = F.col("user").isNotNull(), F.col("sent"), F.coalesce(F.col("ok"), F.lit(False))
    order = ["initiated", *outcomes, "initiated_clean", *[f"{name}_clean" for name in outcomes]]
    found = per_user.groupBy("metric_date").agg(
        F.count_if(known & sent).alias("senders"),
        F.count_if(known & ~sent).alias("recipients"),
        F.count_if(known & sent & clean).alias("senders_clean"),
        F.count_if(known & ~sent & clean).alias("recipients_clean"),
        *[F.sum(n).alias(n) for n in order],
    )
    first, last = order[: 1 + len(outcomes)], order[1 + len(outcomes) :]
    return found.select("metric_date", "senders", "recipients", *first, "senders_clean", "recipients_clean", *last).orderBy("metric_date")


def status_counts(
    alerts: DataFrame, as_of: Moment, days: int = 60, labels: Mapping[int, str] = fixed.CONVERSATION_STATUS
) -> DataFrame:
    """Daily alert counts by decoded status over the last whole days."""
    label = code_label(F.col("status"), labels, "Unknown")
    return (
        closed_days(alerts, "ts", as_of, days)
        .groupBy(F.to_date("ts").alias("metric_date"), label.alias("status_label"))
        .agg(F.count(F.lit(1)).alias("metric_value"))
        .orderBy("metric_date", "status_label")
    )


def fraud_split(alerts: DataFrame, users: DataFrame, initiation: int = 0) -> DataFrame:
    """Daily initiated conversations split by whether the sender's account is disabled."""
    started = (
        alerts.filter(F.col("status") == initiation)
        .groupBy(F.to_date("ts").alias("metric_date"), "from_user")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    roles = with_role(started, "from_user", users, "user_id", {"login_disabled": "_from"})
    is_fraud = F.when(F.col("_from") != 0, 1).otherwise(0)
    return (
        roles.groupBy("metric_date", is_fraud.alias("is_fraud"))
        .agg(F.sum("_n").alias("metric_value"))
        .orderBy("metric_date", "is_fraud")
    )


def trimmed_summary(
    contacts: DataFrame, groups: Sequence[str], sender: str, recipient: str, dims: Sequence[str], deviations: float = 1.5
) -> DataFrame:
    """Senders and recipients per ``dims`` without senders far above their group.

    ``contacts`` has the sender, the recipient and all grouping columns; ``groups`` is
    the part of ``dims`` whose median and deviation set the limit.
    """
    per_sender = contacts.groupBy(*dims, sender).agg(F.count_distinct(recipient).alias("_met"))
    kept = trim_high(per_sender, groups, "_met", deviations, cells=1)
    return (
        kept.groupBy(*dims)
        .agg(F.count_distinct(sender).alias("senders"), F.sum("_met").alias("recipients"))
        .orderBy(*dims)
    )
