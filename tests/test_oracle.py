"""Every registered query against its SQL, strictly: names, types, values."""

import os

import pytest

import __spark_entry__ as entry
from cohortdeck.checks.compare import differences, open_tables
from cohortdeck.checks.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    _, problems = differences(spark, con, name, SF_DIR)
    assert problems == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
