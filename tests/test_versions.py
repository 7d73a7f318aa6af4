"""The commit log: what a batch rewrites, what two writers do to each other, what a crash leaves, what a stream repeats."""

import datetime as dt
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import joins, merges
from sedimenta.plans import fixture, runner
from sedimenta.plans.entities import schema_of
from sedimenta.plans.medallion import KEEP_RUNS, STEPS, Warehouse
from sedimenta.sources.versions import Conflict, Table, put_if_absent, unsorted_writes
from sedimenta.streaming.upserts import stream_table, upsert_stream

T0, NOW = "2026-01-01 08:00:00", dt.datetime(2026, 1, 3)


def staged(spark, name, rows):
    columns = schema_of(name).names
    data = [tuple(r.get(c, T0 if c in ("created_at", "updated_at") else None) for c in columns) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_a_name_is_given_once(spark, tmp_path):
    won = []
    race = [threading.Thread(target=lambda i=i: won.append(i) if put_if_absent(spark, f"{tmp_path}/log/1.json", str(i)) else None) for i in range(12)]
    for t in race:
        t.start()
    for t in race:
        t.join()
    assert len(won) == 1 and (tmp_path / "log" / "1.json").read_text() == str(won[0])
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]


def test_of_two_writers_one_raises(spark, tmp_path):
    Table(spark, f"{tmp_path}/t").replace(spark.range(3))
    one, two = Table(spark, f"{tmp_path}/t"), Table(spark, f"{tmp_path}/t")
    mine, theirs = one.read().selectExpr("id + 10 AS id"), two.read().selectExpr("id + 100 AS id")
    one.replace(mine)
    with pytest.raises(Conflict):
        two.replace(theirs)
    assert sorted(r[0] for r in Table(spark, f"{tmp_path}/t").read().collect()) == [10, 11, 12]
    assert len(list((tmp_path / "t").glob("_v=*"))) == 2  # the loser's files are gone


def test_update_begins_again_from_the_newer_rows(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.replace(spark.range(1))
    calls = []

    def change(now):
        if not calls:  # another writer comes in between
            Table(spark, f"{tmp_path}/t").update(lambda df: df.unionByName(spark.range(5, 6)))
        calls.append(1)
        return now.unionByName(spark.range(9, 10))

    t.update(change)
    assert len(calls) == 2 and sorted(r[0] for r in t.read().collect()) == [0, 5, 9]


def test_parts_keep_their_files(spark, tmp_path):
    t, by = Table(spark, f"{tmp_path}/t"), F.col("id") % 4
    t.replace(spark.range(40), by, {"a": 1})
    before = files(tmp_path / "t")
    state = t.state()
    t.replace_parts(t.read([2], state).where("id > 10"), by, [2], state, {"b": 2})
    assert sorted(r[0] for r in t.read().collect()) == [i for i in range(40) if i % 4 != 2 or i > 10] and t.state().meta == {"a": 1, "b": 2}
    assert {r["_part"] for r in t.read([1, 2], with_part=True).collect()} == {1, 2}
    t.replace_parts(t.read([3]).where("false"), by, [3], t.state())  # a part without rows goes
    assert "3" not in t.state().parts and t.read([3]).count() == 0
    with pytest.raises(ValueError):
        t.replace_parts(spark.range(4), by, [1], t.state())
    assert {f: m for f, m in files(tmp_path / "t").items() if f in before} == before  # what older entries name stays for their readers
    for _ in range(Table.KEEP):
        t.note(t.state())
    assert len(files(tmp_path / "t")) < len(before)  # and goes when no entry that is kept names it


def rental(i, **more):
    return {"rental_id": str(i), "customer_id": str(1 + i % 5), "inventory_id": str(1 + i % 7), "rental_date": "2026-01-01", "due_date": "2026-01-05", "rental_fee": "3.49", "status": "Active", **more}


def test_a_small_batch_rewrites_few_files_and_gives_todays_upsert(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), bucket_rows=20)
    w.ingest("rental", staged(spark, "rental", [rental(i) for i in range(1000)]), "b1", NOW)
    assert w.silver_table("rental").state().meta["buckets"] == 50
    parts = w.silver_table("rental").state().parts
    first = spark.createDataFrame(w.silver("rental").collect(), w.silver("rental").schema)
    later = "2026-01-02 08:00:00"
    batch = [rental(i, updated_at=later, status="Returned", return_date="2026-01-02") for i in range(5)] + [rental(i, updated_at=later) for i in range(2000, 2005)]
    w.ingest("rental", staged(spark, "rental", batch), "b2", NOW + dt.timedelta(days=1))
    now = w.silver_table("rental").state().parts
    assert len(now) == 50 and 1 <= sum(now[p] != parts.get(p) for p in now) <= 10
    clean = spark.read.parquet(f"{tmp_path}/batches/rental/b2/clean")
    want = merges.upsert(first, clean, ["rental_id"], ["_batch_id", "_loaded_at"]).withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    assert sorted(map(repr, want.collect())) == sorted(map(repr, w.silver("rental").select(want.columns).collect()))
    told = {r["rental_id"]: (r["action"], r["old"] and r["old"]["status"], r["new"]["status"]) for r in w.feed("rental", NOW).collect()}
    assert told == {i: ("update", "Active", "Returned") for i in range(5)} | {i: ("insert", None, "Active") for i in range(2000, 2005)}
    # an identical delivery changes nothing, not even a file
    log = w.silver_table("rental").numbers()
    same = [r | {"updated_at": "2026-01-02 09:00:00"} for r in batch[:3]]
    w.ingest("rental", staged(spark, "rental", same), "b3", NOW + dt.timedelta(days=2))
    assert w.silver_table("rental").state().parts == now or w.feed("rental", NOW + dt.timedelta(days=1)) is not None
    assert len(w.silver_table("rental").numbers()) in (len(log), len(log) + 1)


def test_a_table_that_grows_gets_more_buckets(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), bucket_rows=10)
    w.ingest("rental", staged(spark, "rental", [rental(i) for i in range(30)]), "b1", NOW)
    more = [rental(i, updated_at="2026-01-02 08:00:00") for i in range(20, 400)]
    w.ingest("rental", staged(spark, "rental", more), "b2", NOW + dt.timedelta(days=1))
    state = w.silver_table("rental").state()
    assert state.meta["buckets"] == 40 and state.meta["rows"] == 400 and w.silver("rental").select("rental_id").distinct().count() == 400


def test_a_load_meets_only_batches_of_its_time(spark, tmp_path, monkeypatch):
    """What a load reads of bronze does not grow with the number of loads before it."""
    w, read = Warehouse(spark, str(tmp_path)), []
    real = Table.read

    def watched(self, parts=None, state=None, with_part=False):
        if "/bronze/" in self.path:
            read.append(None if parts is None else sorted(parts))
        return real(self, parts, state, with_part)

    monkeypatch.setattr(Table, "read", watched)
    seen = []
    for day in range(2, 7):
        read.clear()
        rows = [rental(i, updated_at=f"2026-01-0{day} 08:00:00") for i in range(day * 10, day * 10 + 3)]
        assert w.ingest("rental", staged(spark, "rental", rows), f"b{day}", NOW + dt.timedelta(days=day))["read"] == 3
        seen.append([list(r) for r in read])
    assert seen == [[], [[0]], [[1]], [[2]], [[3]]]  # the batch of the watermark itself, no other
    monkeypatch.undo()
    assert w.bronze("rental").count() == 15


def test_rows_of_the_newest_stamp_that_come_later(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.ingest("rental", staged(spark, "rental", [rental(1), rental(2), rental(3, rental_date="?")]), "b1", NOW)
    late = staged(spark, "rental", [rental(1), rental(2), rental(3, rental_date="?"), rental(4), rental(5, rental_date="?")])
    assert w.ingest("rental", late, "b2", NOW + dt.timedelta(days=1)) == {"read": 2, "rejected": 1, "merged": 1}
    assert w.ingest("rental", late, "b3", NOW + dt.timedelta(days=2)) == {"read": 0, "rejected": 0, "merged": 0}
    assert w.bronze("rental").count() == 5 and w.silver("rental").count() == 3
    assert {r["occurrence_count"] for r in w.control("rejects", "").collect()} == {1}


def test_a_load_that_fails_once_is_tried_again(spark, tmp_path, monkeypatch):
    w, real, waits = Warehouse(spark, str(tmp_path)), Warehouse.load, []
    monkeypatch.setattr("sedimenta.plans.medallion.time", SimpleNamespace(sleep=waits.append))
    left = {"rental": 2, "review": 9}

    def shaky(self, name, *args):
        if left.get(name, 0):
            left[name] -= 1
            raise OSError("source away")
        return real(self, name, *args)

    monkeypatch.setattr(Warehouse, "load", shaky)
    review = staged(spark, "review", [{"review_id": "1", "customer_id": "1", "content_id": "1", "rating": "3", "review_date": T0}])
    loads = w.ingest_all({"rental": staged(spark, "rental", [rental(1)]), "review": review}, "b1", NOW, tries=3, wait=0.5)
    assert {x.name: (x.error or "", x.merged) for x in loads} == {"rental": ("", 1), "review": ("OSError: source away", 0)}
    assert sorted(waits) == [0.5, 0.5, 1.0, 1.0]
    assert spark.read.json(f"{tmp_path}/failed/review/b1").first()["review_id"] == "1" and w.mark("review") is None
    left.clear()
    assert w.ingest_all({"review": review}, "b2", NOW)[0].merged == 1


def test_steps_of_old_runs_go(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w._append("runs", "run_id long, pipeline string, full_refresh boolean, triggered_by string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error string", [(i, "p", False, "t", "SUCCEEDED", NOW, NOW, None) for i in range(1, KEEP_RUNS + 3)])
    w._append("steps", STEPS, [(i, "s", 0, 0, 0, 0.0, None) for i in range(1, KEEP_RUNS + 3)])
    with w.run("p", NOW) as run_id:
        w.log_steps(run_id, [("s", 0, 0, 0, 0.0, None)])
    kept = sorted(r["run_id"] for r in w.control("steps", STEPS).collect())
    assert run_id == KEEP_RUNS + 3 and kept == list(range(4, KEEP_RUNS + 4)) and w.control("runs", "").count() == KEEP_RUNS + 3


def session(i, **more):
    return {"stream_id": str(i), "customer_id": "1", "content_id": "7", "device_id": "3", "start_time": "2026-01-01 10:00:00", "end_time": "2026-01-01 10:45:00", **more}


def test_marks_of_duplicates_follow_changed_keys(spark, tmp_path):
    """After each of three loads the marks are those of ranking the whole table: rows leave a key, come into one, and the
    lowest id of a key goes or a lower one comes."""
    w = Warehouse(spark, str(tmp_path), bucket_rows=3)
    loads = [
        [session(10), session(30, content_id="8"), session(40, content_id="9"), session(50, content_id="9", device_id="1")],
        [session(20), session(60, content_id="8"), session(70, content_id="9"), session(5, content_id="9")],
        [session(10, content_id="8"), session(5, content_id="5"), session(70, content_id="8"), session(50, content_id="6")],
    ]
    for n, rows in enumerate(loads, 1):
        at = NOW + dt.timedelta(days=n)
        w.ingest("streaming_session", staged(spark, "streaming_session", [r | {"updated_at": f"2026-01-0{n} 08:00:00"} for r in rows]), f"b{n}", at)
        w.flag_silver(at)
        got = {r["stream_id"]: (r["is_duplicate"], r["duplicate_of_id"]) for r in w.silver("streaming_session").collect()}
        groups = {}
        for r in w.silver("streaming_session").collect():
            groups.setdefault((r["customer_id"], r["content_id"], r["device_id"], r["start_time"]), []).append(r["stream_id"])
        assert got == {i: (i != min(g), min(g) if i != min(g) else None) for g in groups.values() for i in g}
        assert w.flag_silver(at) == 0


def test_a_day_of_changes_leaves_other_months_alone(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    w = Warehouse(spark, str(tmp_path))
    runner.run_all(w, fixture.sources(spark, sf_dir), "b1", dt.datetime(2024, 5, 1, 12))
    before = {n: runner.gold_table(w, n).state().parts for n in runner.FACTS}
    assert all(len(p) >= 3 for p in before.values())
    runner.run_all(w, fixture.delta(spark, sf_dir), "b2", dt.datetime(2024, 5, 2, 12))
    after = {n: runner.gold_table(w, n).state().parts for n in runner.FACTS}
    changed = {n: {m for m in after[n] if after[n][m] != before[n].get(m)} for n in runner.FACTS}
    assert changed["inventory_daily_snapshot"] <= {"202404", "202405"}  # from the day after the last snapshot
    assert changed["content_monthly_performance"] <= {"202401", "202405"}  # one late session is of January
    for name, months in changed.items():
        kept = set(before[name]) - months
        assert kept and all((tmp_path / "gold" / name / before[name][m]).exists() for m in kept)


def test_stream_takes_the_newest_event_whichever_batch_brings_it(spark, tmp_path):
    for n, rows in enumerate([[("u", 5, "e5"), ("v", 1, "e1")], [("u", 3, "e3"), ("v", 1, "again"), (None, 9, "x"), ("w", None, "y")], [("v", 2, "e2")]]):
        spark.createDataFrame(rows, "k string, n int, what string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = Table(spark, f"{tmp_path}/t")
    upsert_stream(stream_table(spark, f"{tmp_path}/in", files_per_trigger=1), target, ["k"], "n", f"{tmp_path}/progress").awaitTermination()
    assert sorted(map(tuple, target.read().collect())) == [("u", 5, "e5"), ("v", 2, "e2")]
    done = target.state().meta["ledger"][f"{tmp_path}/progress"]
    assert done == 2
    # a crash between the table's entry and the stream's own note: the last batch is delivered again
    log = target.numbers()
    (tmp_path / "progress" / "commits" / "2").unlink()
    crc = tmp_path / "progress" / "commits" / ".2.crc"
    if crc.exists():
        crc.unlink()
    upsert_stream(stream_table(spark, f"{tmp_path}/in", files_per_trigger=1), target, ["k"], "n", f"{tmp_path}/progress").awaitTermination()
    assert target.numbers() == log


def test_surrogates_of_text_and_of_large_keys(spark):
    rows = [(f"k{i:03d}", None) for i in range(150)] + [("a", 7), ("b", 9)]
    got = merges.with_surrogates(spark.createDataFrame(rows, "k string, s long"), spark.createDataFrame([(9,)], "s long"), "k", "s")
    assert {r["k"]: r["s"] for r in got.collect()} == {f"k{i:03d}": 10 + i for i in range(150)} | {"a": 7, "b": 9}
    big = [(2**60 + i, None) for i in range(120)]
    got = merges.with_surrogates(spark.createDataFrame(big, "k long, s long"), spark.createDataFrame([], "s long"), "k", "s")
    assert [r["s"] for r in got.orderBy("k").collect()] == list(range(1, 121))


def test_a_first_load_moves_and_copies_no_row_twice(spark, tmp_path, monkeypatch):
    """Keys that stand once are not ranked, and the cleansed rows of a first load are its feed; a later try leaves them."""
    ranked, real = [], joins.first_of
    monkeypatch.setattr(joins, "first_of", lambda *a: ranked.append(1) or real(*a))
    w = Warehouse(spark, str(tmp_path))
    w.ingest("rental", staged(spark, "rental", [rental(i) for i in range(20)]), "b1", NOW)
    assert not ranked and not (tmp_path / "changes" / "rental").exists()
    w.ingest("rental", staged(spark, "rental", [rental(3, updated_at="2026-01-02 08:00:00", status="Returned")]), "b1", NOW)
    first = {r["rental_id"]: (r["action"], r["old"], r["new"]["status"]) for r in w.feed("rental").where("entry = 1").collect()}
    assert first == {i: ("insert", None, "Active") for i in range(20)}
    assert [(r["action"], r["old"]["status"], r["new"]["status"]) for r in w.feed("rental", beyond=1).collect()] == [("update", "Active", "Returned")]
    twice = [rental(1), rental(1, updated_at="2026-01-02 08:00:00", status="Returned"), rental(2)]
    w = Warehouse(spark, f"{tmp_path}/twice")
    w.ingest("rental", staged(spark, "rental", twice), "b1", NOW)
    assert sorted((r["rental_id"], r["status"]) for r in w.silver("rental").collect()) == [(1, "Returned"), (2, "Active")] and w.bronze("rental").count() == 3


def test_parts_are_written_without_a_sort_and_the_setting_goes_back(spark, tmp_path):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    t = Table(spark, f"{tmp_path}/t")
    with unsorted_writes(spark):
        with unsorted_writes(spark):
            seen.append(spark.conf.get(name))
        seen.append(spark.conf.get(name))
    assert seen == ["64", "64"] and spark.conf.get(name) == "0"
    t.replace(spark.range(100), F.col("id") % 90)
    assert t.read().count() == 100 and len(t.state().parts) == 90
