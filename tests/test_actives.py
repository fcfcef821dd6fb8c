"""Bitmaps of users against sets."""

import random
from datetime import datetime, timedelta

from cohortdeck.operators import actives
from pyspark.sql import functions as F


def test_bitmaps_equal_sets(spark):
    rnd = random.Random(3)
    rows = [
        (rnd.choice([None, 0, 1, 32_767, 32_768, rnd.randrange(200_000)]), rnd.choice(["a", "a", None]),
         rnd.choice([None, datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(24 * 30))]))
        for _ in range(4000)
    ]
    df = spark.createDataFrame(rows, "u bigint, k string, ts timestamp_ntz")
    half = F.col("u") % 2 == 0
    parts = [actives.daily_bitmaps(df.filter(test), "ts", "u", ["k"]) for test in (half, ~half)]
    days = actives.merged_days(parts[0].unionByName(parts[1]), ["k"])
    known = {(k, ts.date(), u) for u, k, ts in rows if u is not None and ts is not None}
    by_day = {}
    for k, day, u in known:
        for ahead in range(7):
            by_day.setdefault((k, day + timedelta(days=ahead)), set()).add(u)
    last = max(day for _, day, _ in known)
    expected = {(k, day, len(users)) for (k, day), users in by_day.items() if day <= last}
    assert {tuple(r) for r in actives.rolling_actives(days, 7, ["k"]).collect()} == expected
    months = actives.actives(days, F.month("day"), "month", ["k"])
    assert {tuple(r) for r in months.collect()} == {(k, 1, len({u for j, _, u in known if j == k})) for k, _, _ in known}
    assert actives.daily_bitmaps(df.limit(0), "ts", "u").collect() == []
