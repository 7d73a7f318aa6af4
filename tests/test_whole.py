"""Queries that once took a part of their input, on tables larger than that part."""

import pytest

import __spark_entry__
from test_queries import rows

DIR, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def check(spark, duck, name, sql):
    got, want = QUERIES[name](spark, DIR), duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_pool_allocation_over_all_parts(spark, duck):
    check(spark, duck, "pool_allocation", ORACLE["pool_allocation"].replace("WHERE l_partkey <= 200 ", ""))


def test_scd1_merges_all_members(spark, duck):
    check(spark, duck, "scd1_merge", ORACLE["scd1_merge"].replace("c_custkey < 400 AND ", "").replace(" WHERE c_custkey < 400", ""))


@pytest.fixture(scope="module")
def snapshot():
    """(item, day): (on_loan, overdue) over the whole window, from plain loops."""
    import datetime

    import pyarrow.parquet as pq

    one = datetime.timedelta(days=1)
    orders = [(r["o_custkey"], r["o_orderdate"].date(), r["o_orderkey"] % 14, r["o_orderpriority"] == "1-URGENT") for r in pq.read_table(f"{SMALL}/orders.parquet").to_pylist()]
    last, out = max(o[1] for o in orders), {}
    for item in {o[0] for o in orders}:
        day = min(o[1] for o in orders if o[0] == item)
        while day <= last:
            out[item, day] = (0, 0)
            day += one
    for item, begun, days, late in orders:
        for k in range(max(1, days)):
            if (item, begun + k * one) in out:
                out[item, begun + k * one] = (1, max(out[item, begun + k * one][1], int(late)))
    return out


def test_snapshot_over_the_whole_window(spark, snapshot):
    got = QUERIES["inventory_daily_snapshot"](spark, SMALL).collect()
    assert len(got) == len(snapshot) and {(r["item"], r["day"]): (r["on_loan"], r["overdue"]) for r in got} == snapshot


def test_utilisation_over_the_whole_window(spark, snapshot):
    import collections

    import pyarrow.parquet as pq

    nation = {r["c_custkey"]: r["c_nationkey"] for r in pq.read_table(f"{SMALL}/customer.parquet").to_pylist()}
    want = collections.defaultdict(list)
    for (item, day), (on_loan, _) in snapshot.items():
        want[nation[item], day.year * 100 + day.month].append((item, on_loan))
    sums = {k: (sum(x for _, x in v), len(v), len({i for i, _ in v})) for k, v in want.items()}
    got = QUERIES["warehouse_utilisation_monthly"](spark, SMALL).collect()
    assert {(r["c_nationkey"], r["month_key"]): (r["loan_days"], r["days"], r["items"], r["utilisation_bp"]) for r in got} == {k: (n, m, i, (20000 * n + m) // (2 * m)) for k, (n, m, i) in sums.items()}
