"""Who a test counts, from what the site logged about its evaluations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions.extract import is_true, xml_value
from cohortdeck.functions.labels import band, cohort_digit, digit_cohort
from cohortdeck.functions.times import Moment, moment
from cohortdeck.operators.filters import between_moments
from cohortdeck.operators.joins import without_keys

FLAG = "if(lower({0}) IN ('true', '1'), 1, if(lower({0}) IN ('false', '0'), 0, NULL))"


def score_population(
    log: DataFrame,
    entries: DataFrame,
    users: DataFrame,
    excluded: DataFrame,
    signup_from: Moment,
    signup_to: Moment,
    asset: str = "PriceTargetingV1Evaluated",
    position: int = 4,
) -> DataFrame:
    """Users whose score decided their price, with score group and digit.

    ``log``: user_id, entry_id, session_id.  ``entries``: entry_id, asset_key and details
    (XML with Score, ScoreRoundedDown, Honored and IsInTest); each is parsed once, before
    it meets the log.  A user belongs if any evaluation in the test was honoured; of such
    a user the rows that were honoured count, whether in the test or not.  ``users``
    (user_id, testing_guid, login_disabled, signup_ts) must be able to log in and have
    signed up in the period; ``excluded`` (user_id) took part in an earlier phase.

    One row per user, session and evaluation: score, score_group, score_rounded_down,
    honored, digit, signup_day.
    """
    details = F.col("details")
    parsed = entries.filter(F.col("asset_key") == asset).select(
        "entry_id",
        xml_value(details, "//Score", "decimal(20,5)").alias("score"),
        is_true(xml_value(details, "//ScoreRoundedDown")).cast("int").alias("score_rounded_down"),
        xml_value(details, "//Honored").alias("_honored"),
        is_true(xml_value(details, "//IsInTest")).alias("_in_test"),
    )
    parsed = parsed.withColumn("honored", F.coalesce(F.expr(FLAG.format("_honored")), F.lit(0))).drop("_honored")
    seen = log.select("user_id", "entry_id", "session_id").join(parsed, ["entry_id"])
    taken = seen.filter(F.col("_in_test") & (F.col("honored") != 0)).groupBy("user_id").agg(F.max("honored").alias("honored"))
    rows = seen.join(taken, ["user_id", "honored"])
    members = between_moments(users, "signup_ts", signup_from, signup_to).filter(F.col("login_disabled") == 0)
    members = without_keys(members, excluded, ["user_id"]).select(
        "user_id", cohort_digit(F.col("testing_guid"), position).alias("digit"), F.to_date("signup_ts").alias("signup_day")
    )
    edges = [F.lit(edge).cast("decimal(20,5)") for edge in fixed.SCORE_EDGES]
    group = band(F.col("score"), edges, fixed.SCORE_GROUPS)
    return (
        rows.join(members, ["user_id"])
        .select("user_id", "session_id", "score", group.alias("score_group"), "score_rounded_down", "honored", "digit", "signup_day")
        .distinct()
    )


def promo_viewers(
    log: DataFrame,
    entries: DataFrame,
    users: DataFrame,
    cohorts: Mapping[str, str],
    start: Moment,
    end: Moment,
    asset: str = "RateCard",
    position: int = 18,
) -> DataFrame:
    """Views of a promotional rate card on the web, with cohort and whether the user was known before.

    ``entries`` details name the promotion and how the card was reached; default cards and
    those from communication, one-click and mobile paths don't count.  ``users`` holds
    the accounts that may count.  ``new_reg`` is 1 for users who signed up before
    ``start``, as the reports have it.
    """
    details = F.col("details")
    no = {tag: xml_value(details, f"//RateCardLog/{tag}") == "false" for tag in ("IsCommunication", "IsOneClick", "IsMobile")}
    cards = entries.filter((F.col("asset_key") == asset) & (xml_value(details, "//RateCardLog/PromoId") != "default"))
    for test in no.values():
        cards = cards.filter(test)
    views = between_moments(log, "ts", start, end).join(cards.select("entry_id"), ["entry_id"])
    digit = cohort_digit(F.col("testing_guid"), position)
    members = users.filter(~F.col("login_disabled").isin(*fixed.DISABLED_LOGINS)).select(
        "user_id",
        digit.alias("digit"),
        digit_cohort(digit, cohorts).alias("cohort"),
        F.to_date("signup_ts").alias("signup_day"),
        F.when(F.col("signup_ts") < moment(start), 1).otherwise(0).alias("new_reg"),
    )
    return views.join(members, ["user_id"]).select("user_id", "digit", "cohort", "session_id", "ts", "signup_day", "new_reg").distinct()
