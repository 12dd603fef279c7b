"""The contract: names, oracles, and a sample of queries against DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from regiolith.plans import registry

SF = "/root/testdata/sf0.001"
#: Every query of the library with SQL for the same rows; those on training text have tests of their own.
WITH_SQL = sorted(registry.oracle_sql())


def plain(v):
    """Numbers with a fraction as float, nulls and NaN alike, anything else as text."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return float(v) if isinstance(v, (float, decimal.Decimal)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(made, key=lambda r: ([x for x in r if isinstance(x, str)], [x for x in r if isinstance(x, float)]))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 120


def test_flagship_has_rows(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    cursor = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, cursor.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)
