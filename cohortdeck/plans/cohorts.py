"""Who is in a test: cohort assignment, the fraud rule, cohort counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.labels import cohort_digit, dated_cohort, digit_cohort, first_match
from cohortdeck.functions.times import Moment, seconds_between


def with_cohort(
    users: DataFrame, guid: str, position: int, cohorts: Mapping[str, str], default: str | None = None
) -> DataFrame:
    """Add ``digit`` and ``cohort`` from one GUID place."""
    digit = cohort_digit(F.col(guid), position)
    return users.withColumn("digit", digit).withColumn("cohort", digit_cohort(F.col("digit"), cohorts, default))


def with_score_cohort(users: DataFrame, score_group: str, digit: str) -> DataFrame:
    """Add ``cohort`` by score group and digit."""
    rules = [
        (F.col(score_group) == group, digit_cohort(F.col(digit), cohorts))
        for group, cohorts in fixed.SCORE_COHORTS.items()
    ]
    return users.withColumn("cohort", first_match(rules))


def cohort_counts(users: DataFrame, user: str, guid: str, position: int, cohorts: Mapping[str, str], default: str | None = None) -> DataFrame:
    """Distinct users per cohort, users without a cohort left out."""
    return (
        with_cohort(users, guid, position, cohorts, default)
        .filter(F.col("cohort").isNotNull())
        .groupBy("cohort")
        .agg(F.count_distinct(user).alias("users"))
        .orderBy("cohort")
    )


def _judged(
    users: DataFrame,
    resignations: DataFrame,
    user: str = "user_id",
    signup_ts: str = "signup_ts",
    within_seconds: int = fixed.FRAUD_SECONDS,
    resign_type: str = fixed.FRAUD_RESIGN_TYPE,
    excluded_codes: Sequence[int] = fixed.FRAUD_EXCLUDED_CODES,
) -> DataFrame:
    """``users`` with ``_fraud``.  Only a user's earliest resignation can decide."""
    earliest = (
        resignations.filter(
            (F.col("resign_type") == resign_type) & ~F.col("resign_code").isin(*excluded_codes)
        )
        .groupBy(user)
        .agg(F.min("resign_ts").alias("_resigned"))
    )
    soon = seconds_between(F.col(signup_ts), F.col("_resigned")) < within_seconds
    return users.join(earliest, [user], "left").withColumn("_fraud", F.coalesce(soon, F.lit(False))).drop("_resigned")


def fraud_users(users: DataFrame, resignations: DataFrame, user: str = "user_id", **rule) -> DataFrame:
    """Users resigned for fraud soon after signing up.

    ``resignations`` has the user, ``resign_type``, ``resign_code`` and ``resign_ts``;
    the signup time belongs to the user.  A resignation before the signup counts too,
    one with a null code never does.
    """
    return _judged(users, resignations, user, **rule).filter("_fraud").select(user).distinct()


def remove_fraud(users: DataFrame, resignations: DataFrame, user: str = "user_id", **rule) -> DataFrame:
    """``users`` without those the fraud rule catches, in one pass over both inputs."""
    return _judged(users, resignations, user, **rule).filter("NOT _fraud").drop("_fraud")


def dated_cohort_counts(
    rows: DataFrame,
    guid: str,
    position: int,
    ts: str,
    schedule: Sequence[tuple[str, str, Moment, Moment | None]],
    by: Sequence[str] = (),
    distinct: str | None = None,
    control: str = "Control",
    control_factor: str = "0.33333",
) -> DataFrame:
    """Control, scaled control and one column per scheduled cohort.

    Counts rows per value of ``by``, or distinct ``distinct`` units.  The scaled
    control is a whole number; a cohort without rows gives null.
    """
    test = dated_cohort(cohort_digit(F.col(guid), position), F.col(ts), schedule, control)
    measure = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    counts = rows.groupBy(*by, test.alias("_cohort")).agg(measure.alias("_n"))
    scaled = (F.col("_n") * F.lit(control_factor).cast("decimal(10,5)")).cast("decimal(28,0)")
    is_control = F.col("_cohort") == control
    others = dict.fromkeys(label for label, *_ in schedule)
    return counts.groupBy(*by).agg(
        F.sum(F.when(is_control, F.col("_n"))).alias("control"),
        F.sum(F.when(is_control, scaled)).cast("bigint").alias("control_scaled"),
        *[
            F.sum(F.when(F.col("_cohort") == label, F.col("_n"))).alias(label.lower().replace(" ", "_"))
            for label in others
        ],
    )
