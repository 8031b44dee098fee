"""Every query with a DuckDB twin gives the twin's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(float(value), 9)) if isinstance(value, (int, float)) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, sf, name):
    mine = entry.queries()[name](spark, sf)
    theirs = duck.sql(TWINS[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
