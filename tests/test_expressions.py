"""Expression semantics, one frame of literal rows per rule."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortdeck import fixed_values as fixed
from cohortdeck.functions import extract, labels, numbers, texts, times
from cohortdeck.plans import billing, monitoring


def values(spark, column, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column.alias("x")).collect()]


def test_prefix_from_position_zero_keeps_one_less(spark):
    texts_in = [("a" * n,) for n in (198, 199, 200, 201)]
    found = values(spark, F.length(texts.slice_text(F.col("t"), 0, 200)), texts_in, "t string")
    assert found == [198, 199, 199, 199]


def test_char_at_of_short_text_is_its_last(spark):
    assert values(spark, texts.char_at(F.col("t"), 7), [("ABCDEFGH",), ("AB",), (None,)], "t string") == ["G", "B", None]


def test_length_ignores_trailing_blanks_only(spark):
    assert values(spark, texts.text_length(F.col("t")), [(" a  ",), ("   ",)], "t string") == [2, 0]
    assert values(spark, texts.is_blank(F.col("t")), [("  ",), (None,), ("x",)], "t string") == [True, True, False]


def test_underscore_is_a_wildcard(spark):
    data = [("sp_help",), ("spxhelp",), ("sphelp",), ("Replx",)]
    kept = values(spark, texts.matches_none(F.col("t"), fixed.EXCLUDED_OBJECTS), data, "t string")
    assert kept == [False, False, False, False]
    assert values(spark, texts.matches_none(F.col("t"), ["csa_%"]), [("csa",), (None,)], "t string") == [True, None]


def test_prefix_parameter_escapes_wildcards(spark):
    data = [("a%b",), ("axb",)]
    assert values(spark, texts.starts_with_param(F.col("t"), "a%"), data, "t string") == [True, False]
    assert values(spark, texts.starts_with_param(F.col("t"), "a%b", escape=False), data, "t string") == [True, True]


def test_every_digit_gets_its_cohort(spark):
    split = {"Control": "0123", "Test": "456789ABCDEF"}
    data = [(f"xxx{d}",) for d in "0123456789abcdefABCDEF"] + [("xxxG",), (None,)]
    digit = labels.cohort_digit(F.col("g"), 4)
    found = values(spark, labels.digit_cohort(digit, split), data, "g string")
    assert found == ["Control"] * 4 + ["Test"] * 18 + [None, None]
    assert values(spark, labels.digit_cohort(digit, {"Test": "0"}, "Control"), [("xxxG",)], "g string") == ["Control"]


def test_dated_cohort_gap_is_control(spark):
    schedule = [("Test", "0", "2024-01-01", "2024-01-05"), ("Test", "01", "2024-01-06", None)]
    data = [("0", dt.datetime(2024, 1, 1)), ("0", dt.datetime(2024, 1, 5)), ("1", dt.datetime(2024, 1, 2)), ("1", dt.datetime(2024, 1, 6))]
    found = values(spark, labels.dated_cohort(F.col("d"), F.col("ts"), schedule), data, "d string, ts timestamp_ntz")
    assert found == ["Test", "Control", "Control", "Test"]


def test_band_edges_belong_below(spark):
    edges = [F.lit(e).cast("decimal(20,5)") for e in fixed.SCORE_EDGES]
    score = F.col("s").cast("decimal(20,5)")
    data = [("0.4",), ("0.40001",), ("0.8",), ("1.5",), ("18",), ("18.00001",), (None,)]
    assert values(spark, labels.band(score, edges, fixed.SCORE_GROUPS), data, "s string") == [
        "Group 05", "Group 04", "Group 04", "Group 03", "Group 02", "Group 01", None,
    ]


def test_letters(spark):
    assert values(spark, labels.letter_of(F.col("n")), [(0,), (1,), (26,), (27,)], "n int") == [None, "A", "Z", None]


def test_seconds_count_boundaries(spark):
    a, b = dt.datetime(2024, 1, 1, 0, 0, 0, 900000), dt.datetime(2024, 1, 1, 0, 0, 1, 100000)
    found = values(spark, times.seconds_between(F.col("a"), F.col("b")), [(a, b)], "a timestamp_ntz, b timestamp_ntz")
    assert found == [1]
    week = [(dt.datetime(2024, 1, 1, 12, 0, 5), dt.datetime(2024, 1, 8, 12, 0, 4)), (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))]
    found = values(spark, times.seconds_between(F.col("a"), F.col("b")), week, "a timestamp_ntz, b timestamp_ntz")
    assert found == [604799, -86400]


@pytest.mark.parametrize(
    "day, week", [("2014-01-04", 1), ("2014-01-05", 2), ("2014-12-31", 53), ("2012-01-01", 1), ("2012-01-08", 2)]
)
def test_us_week(spark, day, week):
    assert values(spark, times.us_week(F.to_date("d")), [(day,)], "d string") == [week]


def test_month_shift_clamps(spark):
    found = values(spark, times.shift(F.col("t"), 1, "MONTH"), [(dt.datetime(2024, 1, 31),)], "t timestamp_ntz")
    assert found == [dt.datetime(2024, 2, 29)]


def test_rates(spark):
    data = [(1, 4), (0, 4), (4, 0), (None, None)]
    safe = values(spark, numbers.safe_rate(F.col("a"), F.col("b")), data, "a int, b int")
    assert safe == [Decimal("0.2500"), Decimal("0.0000"), Decimal("0.0000"), Decimal("0.0000")]
    plain = values(spark, numbers.nullable_rate(F.col("a"), F.col("b")), data, "a int, b int")
    assert plain == [0.25, 0.0, None, None]


def test_whole_division_truncates_toward_zero(spark):
    assert values(spark, numbers.int_div(F.col("a"), F.col("b")), [(7, 2), (-7, 2), (7, 0)], "a int, b int") == [3, -3, None]


def test_xml_values(spark):
    xml = [("<L><Score>1.50</Score><Flag>True</Flag><B>x</B></L>",), ("<L/>",), (None,)]
    found = values(spark, extract.xml_value(F.col("x"), "//Score", "decimal(20,5)"), xml, "x string")
    assert found == [Decimal("1.50000"), None, None]
    assert values(spark, extract.is_true(extract.xml_value(F.col("x"), "//Flag")), xml, "x string") == [True, False, False]
    assert values(spark, extract.xml_value(F.col("x"), "//B", "int"), xml, "x string") == [None, None, None]


def test_xml_texts_are_those_of_each_value(spark):
    rows = [
        "<L><Score>1.50</Score><Flag>True</Flag><B>x</B></L>", "<L/>", None, "",
        "<L><A><Score>2</Score></A><Score>3</Score><B> a,b </B></L>", "<L><Flag/><B>1<C>2</C></B></L>", "<L a='1'><B>&lt;&#xE9;&apos;</B></L>",
    ]
    paths = ["//Score", "//Flag", "//B", "/L/@a", "count(//B)"]
    rows = [(x,) for x in rows]
    for some in (paths, paths[:1], paths[::-1]):
        for path in some:
            own = values(spark, extract.xml_value(F.col("x"), path), rows, "x string")
            assert values(spark, extract.xml_value(extract.xml_texts(F.col("x"), some), path, among=some), rows, "x string") == own


def test_xml_extract_parses_once(spark):
    from cohortdeck.checks import operators, registry

    assert operators.xml_extract
    plan = registry.QUERIES["xml_extract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("XPath") == 1


def test_xml_record_parses_once(spark):
    xml = [("<L><Score>1.50</Score><B>x</B></L>",), ("<L><Other/></L>",), (None,)]
    record = extract.xml_record(F.col("x"), "Score decimal(20,5), B string")
    assert values(spark, record["Score"], xml, "x string") == [Decimal("1.50000"), None, None]
    assert values(spark, record["B"], xml, "x string") == ["x", None, None]


def test_sites_and_platforms(spark):
    hosts = [("DA1WEB141",), ("EC1WEB211",), ("DA1WEB010",)]
    assert values(spark, monitoring.site_of(F.col("h")), hosts, "h string") == ["ClearView", "DuPont", "ClearView"]
    assert values(spark, monitoring.platform_of(F.col("h")), hosts, "h string") == ["Mobile", "G3", "Main"]


def test_card_outcomes(spark):
    assert values(spark, billing.completion_label(F.col("c")), [(0,), (-7,), (9,), (None,)], "c int") == [
        "Update Successful", "AcctPymtMethUV0 Exception", "Unknown", "Unknown",
    ]
