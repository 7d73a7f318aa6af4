"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from sedimenta.plans import registry

DIR = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return round(v, 9) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(columns)
    return sorted(tuple(repr(plain(r[columns.index(c)])) for c in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
