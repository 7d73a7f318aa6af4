"""How often the rows of a build are moved, and how much room they take where they are written."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import joins
from sedimenta.plans import fixture, gold, layers, runner
from sedimenta.plans.medallion import Warehouse
from sedimenta.sources.versions import READS, SMALL_FILES, small_broadcasts, unsorted_writes

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("moves")))
    runner.run_all(w, fixture.sources(spark, DIR), "b1", dt.datetime(2024, 5, 1, 12))
    return w


def _moves(df) -> list[str]:
    """Shuffles by key of the plan as it is before it is run; a join's sides are not broadcast."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [x for x in text.splitlines() if "Exchange hashpartitioning" in x]


def test_activity_moves_once(warehouse):
    silver, dims = runner.silver_tables(warehouse), runner.star(warehouse)
    moves = _moves(gold.customer_daily_activity(silver, dims["customer"], dims["subscription_plan"], dims["date"]))
    assert len(moves) <= 5, moves  # all acts, versions and subscriptions by customer, plans and what meets them
    assert not [x for x in moves if "activity_date" in x.split("hashpartitioning")[1].split(")")[0]]


def test_snapshot_changes_move_once(warehouse):
    silver, dims = runner.silver_tables(warehouse), runner.star(warehouse)
    first, last = dt.date(2023, 12, 1), dt.date(2024, 4, 1)
    moves = _moves(gold.inventory_daily_snapshot(silver, dims["inventory_item"], dims["content"], dims["warehouse"], first, last))
    assert not [x for x in moves if "day" in x.split("hashpartitioning")[1].split(")")[0]], moves
    # after the changes are made, none of them goes by content or warehouse: these meet items and versions
    assert sum("inventory_id" in x for x in moves) <= 8, moves


def test_asof_listed_is_the_join(spark):
    e = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-05"), (1, "2024-02-01"), (2, "2024-01-01"), (None, "2024-01-01"), (3, None), (4, "2023-12-31")], "k int, d string").withColumn("d", F.col("d").cast("date"))
    v = spark.createDataFrame([(1, "2024-01-01", "2024-01-04", "a"), (1, "2024-01-05", "2024-01-20", "b"), (2, "2023-01-01", None, "c"), (3, "2023-01-01", None, "d"), (4, "2024-01-01", None, "e"), (None, "2023-01-01", None, "f")], "k int, a string, z string, x string")
    v = v.select("k", F.col("a").cast("date").alias("effective_from"), F.col("z").cast("date").alias("effective_to"), "x")
    want = joins.versions_asof(e, v, "k", "d").select("k", "d", "effective_from", "effective_to", "x")
    got = joins.asof_listed(e, v, "k", "d").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_what_is_written_is_packed(warehouse):
    root = Path(warehouse.root)
    parquet = [p.name for p in root.rglob("*.parquet")]
    assert parquet and not [n for n in parquet if not n.endswith(".zstd.parquet")]
    assert all(p.name.endswith(".json.gz") for p in (root / "rejected").rglob("part-*"))


def test_writes_by_part_read_small_pieces(spark):
    c = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(c)
    with unsorted_writes(spark):
        assert spark.conf.get(c) == READS
        with unsorted_writes(spark):
            assert spark.conf.get(c) == READS
        assert spark.conf.get(c) == READS
    assert spark.conf.get(c) == before


def test_builds_broadcast_unasked_only_what_is_very_small(spark, monkeypatch, tmp_path):
    c, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(c)
    w = Warehouse(spark, str(tmp_path))
    monkeypatch.setattr(Warehouse, "ingest_all", lambda *a: seen.append(spark.conf.get(c)) or [])
    monkeypatch.setattr(runner, "prepare", lambda *a: seen.append(spark.conf.get(c)) or 1 / 0)
    runner.extract(w, {}, "b1", dt.datetime(2024, 5, 1, 12))
    with pytest.raises(ZeroDivisionError):
        runner.build_gold(w, dt.datetime(2024, 5, 1, 12))
    assert seen == [SMALL_FILES, SMALL_FILES] and spark.conf.get(c) == before
    spark.conf.set(c, "7")
    try:
        with small_broadcasts(spark):
            assert spark.conf.get(c) == "7"  # what is set stays
    finally:
        spark.conf.unset(c)


def test_facts_are_compared_by_member(spark):
    columns = "k long, d int, x string"
    a = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, None), (2, 1, "b"), (None, 1, "n")] + [(i, 3, "s") for i in range(3, 40)], columns)
    z = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (2, 1, "b"), (4000, 1, "c"), (None, 1, None)] + [(i, 3, "s") for i in range(3, 40)], columns)
    for left, right in ((a, z), (z, a), (a, a), (a.limit(0), z)):
        assert layers.rows_that_differ(left, right, "k") == left.exceptAll(right).count() + right.exceptAll(left).count()
    full = layers.rows_that_differ(a, a.repartition(3), "k")
    assert full == 0


def test_small_buckets_do_not_grow_with_the_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), bucket_rows=20_000)
    assert [w.buckets(n) for n in (0, 1, 20_001, 600_000, 9_000_000, 100_000_000)] == [1, 1, 2, 30, 64, 200]
    assert [Warehouse(spark, str(tmp_path)).buckets(n) for n in (0, 500_001, 100_000_000)] == [1, 2, 200]
