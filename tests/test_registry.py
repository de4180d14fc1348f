"""Registered queries against their reference SQL on the smallest data set.

A few by default; all of them with TABLEWAKE_ALL=1.
"""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from tablewake.plans.views import BASE_TABLES

SF = "/root/testdata/sf0.001"
FEW = ("audit_findings", "dependents_closure", "job_cache_key", "lineage_dag", "join_refs", "normalize_jobs")
NAMES = tuple(entry_points.queries()) if os.environ.get("TABLEWAKE_ALL") else FEW

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def check_engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_reference_sql(spark, check_engine, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = check_engine.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(row[i] for i in order) for row in result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_reference_statement_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
