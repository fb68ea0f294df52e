"""Every registered portal query against its SQL."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from tallyhire.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return str(value.normalize()) if isinstance(value, decimal.Decimal) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA).toArrow()
    names = sorted(found.column_names)
    got = sorted([tuple(plain(r[n]) for n in names) for r in found.to_pylist()], key=str)
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted([tuple(plain(r[columns.index(n)]) for n in names) for r in result.fetchall()], key=str)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
