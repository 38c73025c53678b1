"""Every registered query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from conftest import SF_DIR
from ledgerloom.catalog import CHECKS, QUERIES
from ledgerloom.catalog.views import BASE_TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_duckdb(name, tables, duck):
    found = QUERIES[name](tables)
    expected = duck.execute(CHECKS[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    ours = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in found.collect())
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in expected.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(name, tables):
    assert QUERIES[name](tables).count() > 0
