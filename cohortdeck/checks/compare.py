"""Strict comparison of a query with its SQL: names, types and values."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import SparkSession

from cohortdeck.checks.registry import ORACLES, QUERIES


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(row[i] for i in order) for row in rows]
    return sorted(cells, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> tuple[int, list[str]]:
    """Row count and what differs (nothing when the query matches)."""
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return len(rows), []
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return len(rows), [f"columns {sorted(df.columns)} against {sorted(names)}"]
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows against {len(expected)}")
    ours, theirs = _sorted_rows(df.columns, rows), _sorted_rows(names, expected)
    for a, b in zip(ours, theirs):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            problems.append(f"{a} against {b}")
            if len(problems) > 4:
                break
    return len(rows), problems
