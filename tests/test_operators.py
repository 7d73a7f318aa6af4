"""Merges, versions and helpers on hand-written rows."""

import datetime as dt

from pyspark.sql import functions as F

from sedimenta.functions.text import blank_to_null, full_years, initcap_any, text_to_bigint
from sedimenta.operators import joins, merges, quality
from sedimenta.sources.versions import Table, since


def test_insert_ignore_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a")], "id int, v string")
    batch = spark.createDataFrame([(1, "z"), (2, "b"), (2, "b")], "id int, v string")
    once = merges.insert_ignore(now, batch, ["id"])
    assert sorted(map(tuple, merges.insert_ignore(once, batch, ["id"]).collect())) == [(1, "a"), (2, "b")]


def test_identical_delivery_keeps_stamps(spark):
    now = spark.createDataFrame([(1, None, "b1", True), (2, "x", "b1", False)], "id int, v string, batch string, flag boolean")
    batch = spark.createDataFrame([(1, None, "b2"), (2, "y", "b2"), (3, "n", "b2")], "id int, v string, batch string")
    got = {r["id"]: tuple(r)[1:] for r in merges.upsert(now, batch, ["id"], ["batch"]).collect()}
    assert got == {1: (None, "b1", True), 2: ("y", "b2", False), 3: ("n", "b2", None)}


def test_scd2_steps(spark):
    day = dt.date
    now = spark.createDataFrame([(1, "A", "n", day(1900, 1, 1), None, True), (2, "A", "n", day(2024, 5, 1), None, True), (3, "A", "n", day(1900, 1, 1), None, True)], "id int, s string, name string, effective_from date, effective_to date, is_current boolean")
    new = spark.createDataFrame([(1, "B", "m", day(2024, 3, 2)), (2, "B", "m", day(2024, 3, 2)), (3, "A", "m", day(2024, 3, 2)), (4, "C", "m", day(2024, 3, 2))], "id int, s string, name string, d date")
    got = sorted((r["id"], r["s"], r["name"], r["effective_from"], r["effective_to"], r["is_current"]) for r in merges.scd2(now, new, "id", ["s"], ["name"], "d").collect())
    assert got == [
        (1, "A", "m", day(1900, 1, 1), day(2024, 3, 1), False), (1, "B", "m", day(2024, 3, 2), None, True), (2, "B", "m", day(2024, 5, 1), None, True),
        (3, "A", "m", day(1900, 1, 1), None, True), (4, "C", "m", day(1900, 1, 1), None, True),
    ]


def test_days_between_never_counts_back(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), dt.date(2024, 1, 1)), (dt.date(2024, 1, 1), dt.date(2024, 1, 2))], "a date, b date")
    assert [len(r[0]) for r in df.select(joins.days_between(F.col("a"), F.col("b"))).collect()] == [0, 2]


def test_text_functions(spark):
    df = spark.createDataFrame([("on-hold it", " ", "1.0", dt.date(2000, 2, 29))], "a string, b string, c string, d date")
    r = df.select(initcap_any(F.col("a")), blank_to_null(F.col("b")), text_to_bigint(F.col("c")), full_years(F.col("d"), F.lit(dt.date(2019, 2, 28)))).first()
    assert tuple(r) == ("On-Hold It", None, 1, 18)


def test_validation_names_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    good, bad = quality.split_valid(df, [("v is missing", F.col("v").isNull())])
    assert good.count() == 1 and bad.first()["details"] == "v is missing"


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "k")], "id int, k string")
    assert [(r["id"], r["is_duplicate"], r["duplicate_of_id"]) for r in joins.ranked_duplicates(df, ["k"], "id").orderBy("id").collect()] == [(1, False, None), (2, True, 1), (3, False, None)]


def test_versions_switch_after_the_write(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.replace(spark.range(3))
    t.replace(t.read().where("id > 0"))
    assert t.read().count() == 2


def test_watermark(spark):
    assert since(spark.range(5), "id", 1, 3).count() == 2 and since(spark.range(5), "id", None).count() == 5


def test_repeated_keys_of_a_batch_do_not_multiply(spark):
    now = spark.createDataFrame([(1, "a")], "id int, v string")
    batch = spark.createDataFrame([(1, "z"), (1, "y"), (2, "b"), (2, "c")], "id int, v string")
    assert sorted(map(tuple, merges.upsert(now, batch, ["id"]).collect())) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, merges.insert_ignore(now, batch, ["id"]).collect())) == [(1, "a"), (2, "b")]


def test_delete_between_and_update_from(spark):
    rows = spark.createDataFrame([(1, 5), (1, 9), (2, 5), (None, 5)], "id int, d int")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert sorted(map(str, merges.delete_between(rows, keys, "d", 1, 6).collect())) == ["Row(id=1, d=9)", "Row(id=2, d=5)", "Row(id=None, d=5)"]
    new = spark.createDataFrame([(1, 70), (1, 60), (3, 1)], "id int, d int")
    assert sorted(map(str, merges.update_from(rows, new, ["id"], ["d"], F.col("d") < 8).collect())) == ["Row(id=1, d=60)", "Row(id=1, d=9)", "Row(id=2, d=5)", "Row(id=None, d=5)"]
