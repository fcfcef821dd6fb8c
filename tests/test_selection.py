"""Order statistics against sorting everything."""

import random

import pytest

from cohortdeck.operators import selection


@pytest.mark.parametrize("kind", ["text", "number", "fraction"])
def test_quantiles_equal_sorting(spark, kind):
    rnd = random.Random(1)
    make = {
        "text": lambda: rnd.choice(["ORDER-00000000000", "zzz", "ORDER-0000000000é"]) + str(rnd.randrange(400)),
        "number": lambda: rnd.choice([rnd.randrange(-5, 5), rnd.randrange(10**15)]),
        "fraction": lambda: rnd.choice([0.5, -rnd.random(), rnd.random() * 1e9]),
    }[kind]
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([make(), make(), make(), None])) for _ in range(3000)] + [("one", make()), ("none", None)]
    df = spark.createDataFrame(rows, f"g string, v {({'text': 'string', 'number': 'bigint', 'fraction': 'double'})[kind]}")
    found = selection.discrete_quantiles(df, ["g"], "v", {"low": (0, 1), "mid": (1, 2), "tail": (99, 100), "top": (1, 1)})
    expected = []
    for g in {g for g, _ in rows}:
        values = sorted((v for h, v in rows if h == g and v is not None), key=lambda v: v.encode() if kind == "text" else v)
        if values:
            n = len(values)
            expected.append((g, values[0], values[(n + 1) // 2 - 1], values[-(-99 * n // 100) - 1], values[-1]))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_common_beginnings_are_split(spark):
    """Texts that differ late only are dealt out evenly, within one group."""
    df = spark.range(40_000).selectExpr("'g' AS g", "concat(repeat('ORDER-', 50), lpad(id, 8, '0')) AS v")
    sizes = [r["count"] for r in selection.sorted_ranges(df, ["g"], ["v"]).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


def test_half_equals_sorting(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([1, 1, 1, 2, rnd.randrange(900), None]), k) for k in range(2500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    expected = []
    for g in {g for g, _, _ in rows}:
        own = sorted((v, k) for h, v, k in rows if h == g and v is not None)
        expected += [k for _, k in own[: (len(own) + 1) // 2]]
    assert sorted(r["id"] for r in selection.top_half(df, ["g"], "v", "id").collect()) == sorted(expected)


def test_no_keys_and_no_rows(spark):
    df = spark.range(7).selectExpr("id AS v")
    assert [tuple(r) for r in selection.discrete_quantiles(df, [], "v", {"mid": (1, 2)}).collect()] == [(3,)]
    assert sorted(r["v"] for r in selection.top_half(df, [], "v", "v").collect()) == [0, 1, 2, 3]
    none = df.selectExpr("v", "'g' AS g").limit(0)
    assert selection.discrete_quantiles(none, ["g"], "v", {"mid": (1, 2)}).collect() == []
    assert selection.top_half(none, ["g"], "v", "v").collect() == []
