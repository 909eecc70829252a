"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# The text queries have tests of their own.
QUERIES = {name: fn for name, fn in entry.queries().items() if name.startswith("q_")}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def table_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(float(row[i]) if isinstance(row[i], int) else row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [column[0] for column in want.description]
    assert sorted(got.columns) == sorted(names)
    assert table_rows(got.collect(), got.columns) == table_rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
