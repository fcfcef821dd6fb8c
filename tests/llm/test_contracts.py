"""The registered queries against their SQL, strictly."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry  # noqa: E402
from cohortdeck.checks.compare import open_tables  # noqa: E402
from cohortdeck.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    ours = sorted(tuple(r) for r in df.select(*names).collect())
    found = open_tables(SF_DIR).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    theirs = sorted(tuple(row[columns.index(c)] for c in names) for row in found.fetchall())
    assert sorted(columns) == names
    assert ours == theirs


def test_all_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry.queries())
