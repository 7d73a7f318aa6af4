"""As-of merge, overlap by bins, and trees of digests, against plain loops and the joins that they stand for."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import fingerprints, joins

DAY, ONE = dt.date(2024, 1, 1), dt.timedelta(days=1)


@pytest.mark.parametrize("hot_rows, hot_days", [(10**9, 31), (20, 7), (0, 3)])
def test_asof_merge_is_the_join(spark, hot_rows, hot_days):
    rng = random.Random(3)
    versions = []
    for k in range(12):
        at = DAY + rng.randrange(0, 20) * ONE
        for n in range(rng.randrange(0, 6)):
            end = at + rng.randrange(0, 30) * ONE
            versions.append((k, f"v{k}.{n}", at, None if n == 5 else end))
            at = end + rng.choice([1, 1, 4]) * ONE  # some gaps
    events = [(i, 0 if i % 3 == 0 else rng.randrange(0, 14), DAY + rng.randrange(-5, 120) * ONE) for i in range(400)]
    events += [(1000, None, DAY), (1001, 1, None), (1002, None, None), (1003, 99, DAY), events[0]]
    e = spark.createDataFrame(events, "id int, k int, d date")
    v = spark.createDataFrame(versions, "k int, name string, effective_from date, effective_to date")
    want = joins.versions_asof(e, v, "k", "d").select("id", "k", "d", "name", "effective_from", "effective_to")
    got = joins.asof_merge(e, v, "k", "d", hot_rows, hot_days).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_asof_merge_sorts_once_and_multiplies_nothing(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS k", "date_add(date'2024-01-01', cast(id % 90 AS int)) AS d").write.parquet(f"{tmp_path}/e")
    spark.range(50).selectExpr("id % 7 AS k", "id AS v", "date_add(date'2024-01-01', cast(10 * floor(id / 7) AS int)) AS effective_from", "date_add(date'2024-01-10', cast(10 * floor(id / 7) AS int)) AS effective_to").write.parquet(f"{tmp_path}/v")
    out = joins.asof_merge(spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/v"), "k", "d")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "SortMergeJoin" not in plan and out.count() == 1000


@pytest.mark.parametrize("days", [1, 7, 1000])
def test_overlapping_pairs(spark, days):
    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), DAY + rng.randrange(0, 60) * ONE) for i in range(150)]
    rows = [(i, k, a, a + rng.choice([0, 1, 3, 9, 30]) * ONE) for i, k, a in rows] + [(900, "a", None, DAY), (901, "a", DAY, None), (902, None, DAY, DAY + 5 * ONE), (903, None, DAY, DAY + 5 * ONE)]
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] == y[1] is not None and None not in (x[2], x[3], y[2], y[3]) and x[2] < y[3] and y[2] < x[3]}
    got = joins.overlapping_pairs(spark.createDataFrame(rows, "id int, k string, a date, z date"), "k", "id", "a", "z", days).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def rows_of(spark, change=None):
    rows = [(i, f"a{i % 7}" if i % 5 else None, None if i % 5 else f"a{i % 7}") for i in range(3000)]
    return spark.createDataFrame([change(*r) if change else r for r in rows], "k long, x string, y string")


def made(df):
    return fingerprints.tree(df, "k", ["k"], [F.col("k"), F.col("x"), F.col("y")], leaf=16, fan=8).cache()


def test_trees_tell_order_and_nulls_and_find_what_differs(spark):
    one = made(rows_of(spark))
    assert one.agg(F.max("level")).first()[0] == 3 and one.where("level = 3").count() == 1
    assert fingerprints.unequal_leaves(one, made(rows_of(spark).repartition(7)), fan=8) == []
    swapped = made(rows_of(spark, lambda k, x, y: (k, y, x) if k in (40, 2500) else (k, x, y)))  # a null and a value change places
    assert fingerprints.unequal_leaves(one, swapped, fan=8) == [40 // 16, 2500 // 16]
    fewer = made(rows_of(spark).where("k < 2990"))
    assert fingerprints.unequal_leaves(one, fewer, fan=8) == [2990 // 16, 2999 // 16]
    nothing = made(rows_of(spark).limit(0))
    assert nothing.count() == 0 and fingerprints.unequal_leaves(nothing, nothing, fan=8) == [] and len(fingerprints.unequal_leaves(one, nothing, fan=8)) == 188


def test_no_two_rows_print_alike(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("1:a", "-"), ("a-", None), ("", "a"), ("-", "1:a")], "x string, y string")
    assert df.select(fingerprints.digest(F.col("x"), F.col("y"))).distinct().count() == 6
