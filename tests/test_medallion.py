"""Source rows to bronze, silver and the star schema, on small hand-written batches."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import joins
from sedimenta.plans import gold, layers, views
from sedimenta.plans.entities import NAMES, schema_of
from sedimenta.plans.medallion import Warehouse, change_set, cleansed, typed_rows
from sedimenta.sources.versions import Table, catalog_columns, not_yet_loaded, read_staged_csv

T0, T1, NOW, LATER = "2026-01-01 08:00:00", "2026-01-02 08:00:00", dt.datetime(2026, 1, 3), dt.datetime(2026, 1, 4)


def staged(spark, name, rows):
    columns = schema_of(name).names
    data = [tuple(r.get(c, T0 if c in ("created_at", "updated_at") else None) for c in columns) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))


def typed(spark, name, rows):
    out = cleansed(typed_rows(staged(spark, name, rows), name).where("details = ''"), name)
    return out.withColumns({"is_duplicate": F.lit(False), "duplicate_of_id": F.lit(None).cast("long"), "_loaded_at": F.lit(NOW)})


def session(i, start="2026-01-01 10:00:00", **more):
    return {"stream_id": str(i), "customer_id": "1", "content_id": "7", "device_id": "3", "start_time": start, "end_time": "2026-01-01 10:45:00", **more}


@pytest.mark.parametrize("name", sorted(NAMES))
def test_every_entity_cleanses_an_empty_batch(spark, name):
    assert typed(spark, name, []).count() == 0


def test_cleansing_rules_and_flags(spark):
    r = typed(spark, "streaming_session", [session(1, completion_percentage="112.40"), session(2, watch_duration="9.0", completion_percentage="-1")]).orderBy("stream_id").collect()
    assert [(x["watch_duration"], x["completion_percentage"], x["dq_flags"]) for x in r] == [(45, Decimal("100.00"), "WATCH_DURATION_DERIVED,COMPLETION_CAPPED"), (9, Decimal("0.00"), "COMPLETION_FLOORED")]
    base = {"rental_id": "1", "customer_id": "1", "inventory_id": "1", "rental_date": "2026-01-01", "due_date": "2026-01-05", "rental_fee": "3.49", "status": "on-hold "}
    r = typed(spark, "rental", [base | {"late_fee": "-2"}, base | {"rental_id": "2", "return_date": "2026-01-04", "late_fee": "-2", "status": "Returned"}]).orderBy("rental_id").collect()
    assert [(x["status"], x["late_fee"], x["dq_flags"]) for x in r] == [("On-Hold", Decimal("2.00"), "STATUS_STANDARDISED,LATE_FEE_SIGN_FIXED"), ("Returned", Decimal("0.00"), "LATE_FEE_ZEROED")]


def test_ingest_is_incremental_and_replay_safe(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    rows = [session(1), session(2), session(3, start=None), session(4, watch_duration="x")]
    source = staged(spark, "streaming_session", rows)
    with w.run("silver", NOW) as run_id:
        assert w.ingest("streaming_session", source, "b1", NOW) == {"read": 4, "rejected": 3, "merged": 1}
        w.log_steps(run_id, [("streaming_session", 1, 0, 0, 0.5, None)])
    again = w.ingest("streaming_session", source, "b2", LATER)
    assert again == {"read": 0, "rejected": 0, "merged": 0}
    assert w.silver("streaming_session").first()["_batch_id"] == "b1"
    rejects = {r["details"]: (r["reason"], r["occurrence_count"]) for r in w.control("rejects", "").collect()}
    assert rejects == {"start_time is missing": ("VALIDATION", 1), "watch_duration: not a int": ("VALIDATION", 1), "same as 1": ("DUPLICATE", 1)}
    assert spark.read.json(f"{tmp_path}/rejected/streaming_session/b1").count() == 3
    late = staged(spark, "streaming_session", [session(1, watch_duration="30", updated_at=T1), session(5, updated_at=T1)])
    assert w.ingest("streaming_session", late, "b3", LATER)["read"] == 2
    assert w.bronze("streaming_session").count() == 6  # rejected rows with a key land too
    w.flag_silver(LATER)
    assert [tuple(r) for r in w.silver("streaming_session").orderBy("stream_id").select("stream_id", "is_duplicate", "duplicate_of_id").collect()] == [(1, False, None)]
    assert w.control("audit", "").count() == 6
    unreadable = staged(spark, "streaming_session", [session(7, updated_at="?")])
    assert w.ingest("streaming_session", unreadable, "b4", LATER) == {"read": 1, "rejected": 1, "merged": 0}
    loads = w.ingest_all({"streaming_session": source, "rental": source.select(F.lit(1).alias("x"), F.expr("raise_error('no such file')").alias("y"))}, "b5", LATER)
    assert [(x.name, x.error is None) for x in loads] == [("rental", False), ("streaming_session", True)]
    assert w.control("failed", "").select("table_name").collect()[0][0] == "rental" and w.mark("rental") is None
    with pytest.raises(RuntimeError):
        with w.run("silver", LATER):
            raise RuntimeError("source away")
    assert [(r["run_id"], r["steps"]) for r in w.run_log().collect()] == [(2, 0), (1, 1)]
    assert [(r["run_id"], r["status"], r["error"]) for r in w.control("runs", "").orderBy("run_id").collect()] == [(1, "SUCCEEDED", None), (2, "FAILED", "source away")]


def test_duplicates_across_batches_are_flagged(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(1)]), "b1", NOW)
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(9, updated_at=T1)]), "b2", NOW)
    w.flag_silver(LATER)
    got = w.silver("streaming_session").orderBy("stream_id").select("stream_id", "is_duplicate", "duplicate_of_id", "_loaded_at").collect()
    assert list(map(tuple, got)) == [(1, False, None, NOW), (9, True, 1, LATER)]
    touched = change_set({"streaming_session": w.feed("streaming_session", NOW, LATER)}, {"streaming_session": w.silver("streaming_session")})
    assert [tuple(r) for r in touched["customer"].collect()] == [(1, 202601)] and [r[0] for r in touched["month"].collect()] == [202601]


def test_flags_of_a_later_load_move_no_bucket_to_join_it(spark, tmp_path, monkeypatch):
    """A few changed rows go to the index and to silver; each of four joins shuffled whole buckets for them."""
    w = Warehouse(spark, str(tmp_path))
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(i, start=f"2026-01-01 10:{i:02}:00") for i in range(1, 40)]), "b1", NOW)
    w.flag_silver(NOW)
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(90, start="2026-01-01 10:07:00", updated_at=T1), session(3, start="2026-01-01 10:05:00", updated_at=T1)]), "b2", LATER)

    def refused(df):
        raise AssertionError("shuffled for a few rows")

    monkeypatch.setattr(joins, "apart", refused)
    assert w.flag_silver(LATER) == 2
    marked = w.silver("streaming_session").where("is_duplicate").orderBy("stream_id").select("stream_id", "duplicate_of_id").collect()
    assert [tuple(r) for r in marked] == [(5, 3), (90, 7)]
    monkeypatch.undo()
    monkeypatch.setattr(joins, "FEW", 0)  # many rows are shuffled, with the same marks
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(3, start="2026-01-01 10:07:00", updated_at="2026-01-03 08:00:00")]), "b3", dt.datetime(2026, 1, 5))
    assert w.flag_silver(dt.datetime(2026, 1, 5)) == 3
    marked = w.silver("streaming_session").where("is_duplicate").orderBy("stream_id").select("stream_id", "duplicate_of_id").collect()
    assert [tuple(r) for r in marked] == [(7, 3), (90, 3)]


def kept(df, path):
    """Tables are read from files here as they are between runs."""
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("silver")
    customer = {"customer_no": "C", "first_name": " Ann", "last_name": "Li ", "registration_date": "2026-01-01", "date_of_birth": "2000-02-29", "status": "active "}
    rows = {
        "country": [{"country_id": "1", "country_name": "Peru", "country_code": "pe"}],
        "city": [{"city_id": "1", "country_id": "1", "city_name": "Lima"}],
        "warehouse": [{"warehouse_id": "1", "city_id": "1", "warehouse_name": "North"}, {"warehouse_id": "2", "city_id": "9", "warehouse_name": "South"}],
        "subscription_plan": [{"plan_id": "1", "plan_name": "Basic", "monthly_fee": "5"}, {"plan_id": "2", "plan_name": "Top", "monthly_fee": "9"}, {"plan_id": "3", "plan_name": "Also basic", "monthly_fee": "5"}],
        "customer": [customer | {"customer_id": "1", "email": "A@x.org"}, customer | {"customer_id": "2", "email": "b@x.org"}],
        "customer_address": [{"address_id": "1", "customer_id": "1", "city_id": "1", "address_type": "home"}, {"address_id": "2", "customer_id": "1", "city_id": "9", "address_type": "Billing", "updated_at": T1}],
        "customer_subscription": [{"subscription_id": "1", "customer_id": "1", "plan_id": "1", "start_date": "2025-12-01", "status": "Active"}, {"subscription_id": "2", "customer_id": "1", "plan_id": "2", "start_date": "2026-01-02", "status": "Active"}],
        "content_type": [{"content_type_id": "1", "content_type": "Movie"}],
        "genre": [{"genre_id": "1", "genre_name": "War"}, {"genre_id": "2", "genre_name": "Art"}],
        "artist": [{"artist_id": "1", "artist_name": "P"}, {"artist_id": "2", "artist_name": "Q"}],
        "content": [{"content_id": "7", "content_type_id": "1", "title": "T", "duration_minutes": "90.0"}, {"content_id": "8", "content_type_id": "1", "title": "U"}],
        "content_genre": [{"content_id": "7", "genre_id": "1"}, {"content_id": "7", "genre_id": "2"}],
        "content_artist": [{"content_id": "7", "artist_id": "1", "role": "Gaffer"}, {"content_id": "7", "artist_id": "2", "role": "Author"}],
        "inventory_item": [{"inventory_id": "1", "content_id": "7", "warehouse_id": "1", "purchase_date": "2026-01-02", "status": "available"}, {"inventory_id": "2", "content_id": "8", "warehouse_id": "2", "purchase_date": "2026-01-01", "status": "Retired"}],
        "rental": [
            {"rental_id": "1", "customer_id": "1", "inventory_id": "1", "rental_date": "2026-01-01", "due_date": "2026-01-02", "return_date": "2026-01-04", "rental_fee": "3", "status": "Returned"},
            {"rental_id": "2", "customer_id": "2", "inventory_id": "1", "rental_date": "2026-01-03", "due_date": "2026-01-09", "rental_fee": "3", "status": "Active"},
            {"rental_id": "3", "customer_id": "2", "inventory_id": "2", "rental_date": "2026-01-02", "due_date": "2026-01-09", "return_date": "2026-01-02", "rental_fee": "3", "status": "Returned"},
        ],
        "streaming_session": [session(1, completion_percentage="95"), session(2, "2026-01-01 12:00:00", watch_duration="15"), session(3, "2026-01-02 10:00:00", content_id="8", watch_duration="60", completion_percentage="50")],
        "payment": [
            {"payment_id": "1", "customer_id": "1", "subscription_id": "1", "payment_method_id": "1", "amount": "-10", "payment_date": "2026-01-01 09:00:00", "payment_type": "subscription", "status": "completed"},
            {"payment_id": "2", "customer_id": "1", "rental_id": "1", "payment_method_id": "1", "amount": "3", "payment_date": "2026-02-01 09:00:00", "payment_type": "Rental", "status": "Completed"},
            {"payment_id": "3", "customer_id": "99", "payment_method_id": "1", "amount": "4", "payment_date": "2026-01-01 09:00:00", "payment_type": "Rental", "status": "Refunded"},
        ],
        "review": [{"review_id": "1", "customer_id": "1", "content_id": "7", "rating": "4", "review_date": T0}, {"review_id": "2", "customer_id": "2", "content_id": "7", "rating": "0", "review_date": T0}],
        "wishlist": [{"wishlist_id": "1", "customer_id": "1", "content_id": "8", "added_date": T0}],
        "support_ticket": [{"ticket_id": "1", "customer_id": "2", "category_id": "1", "opened_date": T1, "status": "Open"}],
    }
    return {name: kept(typed(spark, name, r), root / name) for name, r in rows.items()}


@pytest.fixture(scope="module")
def dims(silver, tmp_path_factory):
    root = tmp_path_factory.mktemp("gold")
    return {n: kept(getattr(gold, f"dim_{n}")(silver), root / n) for n in ("customer", "subscription_plan", "content", "warehouse", "inventory_item")}


def test_type_1_dimensions(silver, dims):
    assert [(r["plan_id"], r["plan_tier"], r["subscription_plan_key"]) for r in dims["subscription_plan"].orderBy("plan_id").collect()] == [(1, 1, 1), (2, 2, 2), (3, 1, 3)]
    assert {r["action"] for r in gold.dim_subscription_plan(silver, dims["subscription_plan"].drop("action")).collect()} == {"kept"}
    assert [(r["city"], r["country_code"]) for r in dims["warehouse"].orderBy("warehouse_id").collect()] == [("Lima", "PE"), ("Unknown", "??")]
    c = dims["content"].orderBy("content_id").collect()
    assert [(r["primary_genre"], r["genre_list"], r["primary_artist"], r["duration_band"], r["availability"]) for r in c] == [("War", "Art, War", "Q", "90-149 min", "Streaming & Rental"), ("Unclassified", "Unclassified", "Not credited", "Not applicable", "Streaming & Rental")]


def test_type_2_versions_keep_their_keys(silver, dims, tmp_path):
    one = dims["customer"]
    assert [(r["customer_id"], r["customer_key"], r["full_name"], r["age_band"], r["customer_status"], r["home_city"]) for r in one.orderBy("customer_id").collect()] == [(1, 1, "Ann Li", "25-34", "Active", "Lima"), (2, 2, "Ann Li", "25-34", "Active", "Unknown")]
    moved = silver | {"customer": silver["customer"].withColumns({"status": F.when(F.col("customer_id") == 1, "Suspended").otherwise(F.col("status")), "updated_at": F.lit(LATER)})}
    two = kept(gold.dim_customer(moved, one), tmp_path / "two")
    got = [(r["customer_id"], r["customer_key"], r["customer_status"], str(r["effective_from"]), str(r["effective_to"]), r["is_current"]) for r in two.orderBy("customer_id", "effective_from").collect()]
    assert got == [(1, 1, "Active", "1900-01-01", "2026-01-03", False), (1, 3, "Suspended", "2026-01-04", "9999-12-31", True), (2, 2, "Active", "1900-01-01", "9999-12-31", True)]
    assert sorted(map(tuple, gold.dim_customer(moved, two).select(two.columns).collect())) == sorted(map(tuple, two.collect()))


def test_customer_daily_activity(spark, silver, dims):
    dates = gold.dim_date(spark, "2026-01-01", "2026-02-15")
    args = (dims["customer"], dims["subscription_plan"], dates)
    fact = gold.customer_daily_activity(silver, *args)
    got = {(r["customer_id"], r["date_key"]): r for r in fact.collect()}
    assert sorted(got) == [(1, 20260101), (1, 20260102), (1, 20260104), (1, 20260201), (2, 20260101), (2, 20260102), (2, 20260103), (99, 20260101)]
    r = got[1, 20260101]
    assert (r["streaming_session_count"], r["streaming_minutes"], r["distinct_titles_streamed"], r["completed_stream_count"], r["rental_count"], r["subscription_amount_spent"], r["review_count"], r["wishlist_add_count"]) == (2, 60, 1, 1, 1, Decimal("10.00"), 1, 1)
    assert [got[k]["subscription_plan_key"] for k in sorted(got)] == [1, 2, 2, 2, 0, 0, 0, 0]
    assert (got[1, 20260104]["late_return_count"], got[99, 20260101]["customer_key"], got[99, 20260101]["refunded_amount"]) == (1, -1, Decimal("4.00"))
    only = spark.createDataFrame([(1,), (99,)], "customer_id long")
    assert {k for k in got if k[0] != 2} == {(r["customer_id"], r["date_key"]) for r in gold.customer_daily_activity(silver, *args, only).collect()}
    assert gold.dim_month(dates).orderBy("month_key").collect()[1]["days_in_month"] == 28


def test_content_monthly_performance(spark, silver, dims):
    got = {(r["content_id"], r["month_key"]): r for r in gold.content_monthly_performance(silver, dims["content"]).collect()}
    assert sorted(got) == [(7, 202601), (7, 202602), (8, 202601)]
    r = got[7, 202601]
    assert (r["stream_count"], r["unique_viewer_count"], r["rental_count"], r["unique_renter_count"], r["rental_revenue"], r["allocated_subscription_revenue"], r["review_count"], r["rated_review_count"], r["avg_customer_rating"], r["avg_completion_pct"]) == (2, 1, 2, 2, Decimal("0.00"), Decimal("5.00"), 2, 1, Decimal("4.00"), Decimal("95.00"))
    assert (got[7, 202602]["total_revenue"], got[7, 202602]["avg_completion_pct"]) == (Decimal("3.00"), None)
    only = spark.createDataFrame([(202602,)], "month_key int")
    assert [(r["content_id"], r["month_key"]) for r in gold.content_monthly_performance(silver, dims["content"], only).collect()] == [(7, 202602)]


def test_inventory_daily_snapshot_and_its_extension(spark, silver, dims):
    dims = (dims["inventory_item"], dims["content"], dims["warehouse"])
    whole = gold.inventory_daily_snapshot(silver, *dims, "2026-01-01", "2026-01-05")
    rows = {(r["inventory_id"], r["date_key"] % 100): (r["days_rented"], r["is_overdue"], r["rental_count"], r["return_count"]) for r in whole.collect()}
    assert rows == {
        (1, 1): (1, 0, 1, 0), (1, 2): (1, 0, 0, 0), (1, 3): (1, 1, 1, 0), (1, 4): (1, 0, 0, 1), (1, 5): (1, 0, 0, 0),
        (2, 1): (0, 0, 0, 0), (2, 2): (1, 0, 1, 1),
    }
    old = gold.inventory_daily_snapshot(silver, *dims, "2026-01-01", "2026-01-03")
    changed = spark.createDataFrame([(2, None)], "inventory_id long, from_date date")
    targets = gold.snapshot_targets(silver["inventory_item"], changed, "2026-01-01", "2026-01-03", "2026-01-05")
    new = gold.inventory_daily_snapshot(silver, *dims, "2026-01-01", "2026-01-05", targets)
    both = old.join(changed.select("inventory_id"), "inventory_id", "left_anti").select(new.columns).unionByName(new)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.select(new.columns).collect()))


def test_views_over_the_star_schema(spark, silver, dims):
    dates = gold.dim_date(spark, "2026-01-01", "2026-02-15")
    plans = views.with_members(dims["subscription_plan"], "subscription_plan_key", {0: {"plan_name": "No plan"}, -1: {"plan_name": "Unknown"}})
    star = dims | {"date": dates, "month": gold.dim_month(dates), "subscription_plan": plans}
    star["customer_daily_activity"] = gold.customer_daily_activity(silver, dims["customer"], dims["subscription_plan"], dates)
    star["content_monthly_performance"] = gold.content_monthly_performance(silver, dims["content"])
    star["inventory_daily_snapshot"] = gold.inventory_daily_snapshot(silver, dims["inventory_item"], dims["content"], dims["warehouse"], "2026-01-01", "2026-01-05")
    got = {n: v(star).collect() for n, v in views.VIEWS.items()}
    assert all(not {"email", "phone", "date_of_birth", "full_name"} & set(v(star).columns) for v in views.VIEWS.values())
    a = {(r["customer_id"], str(r["activity_date"])): r for r in got["customer_daily_activity"]}
    assert len(a) == 7 and a[1, "2026-01-01"]["streamed_and_rented_same_day"] and a[2, "2026-01-01"]["subscription_plan"] == "No plan"
    assert sorted((r["performance_month"], r["content_id"], r["popularity_rank_in_month"]) for r in got["content_monthly_performance"]) == [("2026-01", 7, 1), ("2026-01", 8, 2), ("2026-02", 7, 1)]
    assert len(got["inventory_daily_utilisation"]) == 7
    assert sorted((r["warehouse_name"], r["items_in_service"], r["item_days_rented"], r["utilisation_pct"]) for r in got["warehouse_utilisation_monthly"]) == [("North", 1, 5, Decimal("100.00")), ("South", 1, 1, Decimal("50.00"))]
    k = {r["month"]: r for r in got["monthly_business_kpis"]}
    assert sorted(k) == ["2026-01", "2026-02"] and k["2026-02"]["inventory_utilisation_pct"] is None and k["2026-02"]["revenue_per_active_customer"] is None
    r = k["2026-01"]
    assert (r["active_customers"], r["streaming_hours"], r["refunds"], r["inventory_utilisation_pct"], r["revenue_per_active_customer"]) == (2, Decimal("2.0"), Decimal("4.00"), Decimal("85.71"), Decimal("5.00"))


def test_watermark_reaches_the_scan(spark, tmp_path):
    spark.sql("SELECT id, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(id) AS updated_at FROM range(10)").write.parquet(f"{tmp_path}/s")
    new = not_yet_loaded(spark.read.parquet(f"{tmp_path}/s"), "updated_at", dt.datetime(2026, 1, 6))
    assert new.count() == 5  # with the rows of the watermark itself
    assert "GreaterThanOrEqual(updated_at" in new._jdf.queryExecution().toString()


def test_versions_survive_a_torn_write(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    for i in range(5):
        t.replace(spark.range(i))
    assert t.read().count() == 4
    spark.range(99).write.parquet(f"{tmp_path}/t/_v=xtorn")  # written, never named
    assert t.read().count() == 4 and len(list((tmp_path / "t").glob("_v=*"))) == Table.KEEP + 1
    t.replace(spark.range(0))
    assert t.read().count() == 0


def test_staged_csv_and_catalog(spark, tmp_path):
    (tmp_path / "genre.csv").write_text("genre_id,genre_name,created_at,updated_at\n1, War ,2026-01-01 00:00:00,2026-01-01 00:00:00\n,x,2026-01-01 00:00:00,2026-01-01 00:00:00\n")
    rows = typed_rows(read_staged_csv(spark, str(tmp_path / "genre.csv"), schema_of("genre")), "genre")
    assert [(r["genre_id"], r["details"]) for r in rows.orderBy("details").collect()] == [(1, ""), (None, "genre_id is missing")]
    rows.createOrReplaceTempView("staged_genre")
    columns = catalog_columns(spark).where("table_name = 'staged_genre'").orderBy("ordinal").collect()
    assert [(r["column_name"], r["data_type"]) for r in columns][:2] == [("payload", "string"), ("genre_id", "bigint")]


def test_known_rows_that_become_duplicates_leave_no_stale_row(spark, tmp_path):
    """Two sessions move onto one business key in one delivery: the second is known, so it moves too and is marked."""
    w = Warehouse(spark, str(tmp_path))
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(1), session(2, start="2026-01-01 11:00:00"), session(3, start="2026-01-01 12:00:00")]), "b1", NOW)
    w.flag_silver(NOW)
    there = "2026-02-01 09:00:00"
    moved = staged(spark, "streaming_session", [session(i, start=there, end_time="2026-02-01 09:45:00", updated_at=T1) for i in (2, 3, 4)])
    assert w.ingest("streaming_session", moved, "b2", LATER) == {"read": 3, "rejected": 1, "merged": 2}
    w.flag_silver(LATER)
    rows = w.silver("streaming_session").orderBy("stream_id").select("stream_id", F.date_format("start_time", "yyyy-MM"), "is_duplicate", "duplicate_of_id").collect()
    assert [tuple(r) for r in rows] == [(1, "2026-01", False, None), (2, "2026-02", False, None), (3, "2026-02", True, 2)]
    assert [r["details"] for r in w.control("rejects", "").collect()] == ["same as 2"]


def test_loans_of_retired_items_change_days_before_them(spark):
    """The last loan tells how long a retired item stays, so all of its days are built anew; another item's from the loan on."""
    item = {"content_id": "1", "warehouse_id": "1", "purchase_date": "2026-01-01"}
    items = typed(spark, "inventory_item", [item | {"inventory_id": "1", "status": "Retired"}, item | {"inventory_id": "2", "status": "Available"}])
    loan = {"customer_id": "1", "rental_date": "2026-03-01", "due_date": "2026-03-05", "rental_fee": "3.49", "status": "Active"}
    loans = typed(spark, "rental", [loan | {"rental_id": "1", "inventory_id": "1"}, loan | {"rental_id": "2", "inventory_id": "2"}])
    new = F.struct(*loans.columns)
    feed = loans.select("rental_id", F.lit("insert").alias("action"), F.when(F.lit(False), new).alias("old"), new.alias("new"))
    found = change_set({"rental": feed}, {"rental": loans, "inventory_item": items})["inventory"].orderBy("inventory_id").collect()
    assert [tuple(r) for r in found] == [(1, None), (2, dt.date(2026, 3, 1))]


def test_a_row_that_moved_onto_anothers_business_key_is_no_change(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path))
    w.ingest("streaming_session", staged(spark, "streaming_session", [session(1), session(2, "2026-01-01 11:00:00"), session(3, "2026-01-01 12:00:00")]), "b1", layers.NOW)
    late = [session(2, watch_duration="9", updated_at=T1), session(3, "2026-01-01 12:30:00", updated_at=T1), session(4, "2026-01-01 12:30:00", updated_at=T1), session(5, "2026-01-01 13:00:00", updated_at=T1)]
    w.ingest("streaming_session", staged(spark, "streaming_session", late), "b2", layers.MOVED_AT)
    monkeypatch.setattr(layers, "moved_silver", lambda *a: w)
    assert sorted((r["row_key"], r["action"]) for r in layers.feed_of_moves(spark, "").collect()) == [("3", "update"), ("5", "insert")]


def test_an_id_that_is_used_again_is_another_rental(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path))
    base = {"customer_id": "1", "inventory_id": "1", "rental_date": "2026-01-01", "due_date": "2026-01-05", "rental_fee": "3.49", "status": "Active"}
    w.ingest("rental", staged(spark, "rental", [base | {"rental_id": i} for i in ("6", "900001")]), "b1", NOW)
    w.ingest("rental", staged(spark, "rental", [base | {"rental_id": "6", "updated_at": T1}, base | {"rental_id": "900001", "created_at": T1, "updated_at": T1}]), "b2", LATER)
    monkeypatch.setattr(layers, "built", lambda *a, **k: w)
    assert sorted(map(tuple, layers.bronze_versions(spark, "").collect())) == [(6, 2), (900001, 1), (900001, 1)]
