"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrylight import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return [cell(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_spark_and_sql_agree(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(repr([cell(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(repr([cell(row[i]) for i in order]) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run_and_repeat(name, spark, data):
    def rows():
        return sorted(repr(r) for r in QUERIES[name](spark, data).collect())

    assert rows() == rows()


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
