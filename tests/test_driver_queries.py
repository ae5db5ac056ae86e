"""Every registered query of the engine against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from docledger.plans import driver_queries, fault_queries, reading_queries, state_queries, vault_queries

PLANS = (driver_queries, vault_queries, reading_queries, state_queries, fault_queries)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, os.environ.get("TEST_SF_DIR", SF))
    rows = found.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, rows) == rows_of(columns, want.fetchall())
