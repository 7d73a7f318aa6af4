"""From staged source rows to bronze and silver, with runs, steps, audit, rejects and watermarks in control tables.

A batch is first written under its id; everything else derives from that copy, so a batch that is started again does
the same again. All tables are versioned (sources.versions). Bronze has a part for each batch, with the range of its
stamps in the log, so that a batch meets only those that can hold its rows. Silver is cut into buckets by key: a batch
reads and rewrites the buckets that its rows fall into. Each change of silver leaves a feed, the old and the new row
of every key that changed, whose place stands in the same log entry; what is built on silver starts from these feeds.

Entities load side by side: a load writes its own tables only, and what loads report goes into the control tables
together, watermarks last. Control tables hold a row for each run, step, batch or distinct reject.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import flags
from sedimenta.operators import joins, merges
from sedimenta.plans.entities import FLAGGED, business_key, clean_columns, flag_rules, key_of, schema_of
from sedimenta.sources.versions import Commit, Conflict, Table, not_yet_loaded, packed

RUNS = "run_id long, pipeline string, full_refresh boolean, triggered_by string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error string"
STEPS = "run_id long, step string, rows_inserted long, rows_updated long, rows_deleted long, seconds double, note string"
AUDIT = "batch_id string, layer string, table_name string, n_rows long, loaded_at timestamp_ntz"
MARKS = "name string, value timestamp_ntz"
REJECTS = "payload_hash string, table_name string, reason string, details string, payload string, first_batch string, last_batch string, occurrence_count long"
FAILED = "batch_id string, table_name string, error string, failed_at timestamp_ntz"
KEEP_RUNS = 50
#: Rows of a bucket of silver when it is made; a table that outgrows its buckets fourfold gets more of them.
BUCKET_ROWS = 500_000
#: Buckets of fewer rows than that are made up to so many: each is a folder that a read lists and a file that a task writes.
MANY_BUCKETS = 64
STAMPED = ["_batch_id", "_loaded_at"]


def typed_rows(raw: DataFrame, name: str) -> DataFrame:
    """Columns cast to the schema's types, with `details` naming missing and unreadable values; `payload` is the raw row.

    A column that the source lacks counts as null, one that the schema lacks is named in `details`.
    """
    schema = schema_of(name)
    out, wrong = [F.to_json(F.struct(*raw.columns)).alias("payload")], []
    for f in schema:
        kind = f.dataType.simpleString()
        text = F.nullif(F.col(f.name).cast("string"), F.lit("")) if f.name in raw.columns else F.lit(None).cast("string")
        # integers may be staged as `1.0`
        value = text.try_cast("decimal(20,4)").try_cast(kind) if kind in ("bigint", "int") else text.try_cast(kind)
        out.append(value.alias(f.name))
        wrong.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{f.name}: not a {kind}")))
        if not f.nullable:
            wrong.append(F.when(text.isNull(), F.lit(f"{f.name} is missing")))
    unknown = [F.lit(f"{c} is not in the schema") for c in raw.columns if c not in schema.names]
    return raw.select(*out, F.concat_ws("; ", *wrong, *unknown).alias("details"))


def cleansed(rows: DataFrame, name: str) -> DataFrame:
    """Clean columns and dq_flags; rules and flags both see raw values."""
    replaced, rules = clean_columns(name), flag_rules(name)
    fired = flags(rules) if rules else F.lit(None).cast("string")
    return rows.select(*[replaced.get(c, F.col(c)).alias(c) for c in schema_of(name).names], fired.alias("dq_flags"))


def _keyed(rows: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    same = business_key(name)
    names = [f"_k{i}" for i in range(len(same))]
    return rows.withColumns(dict(zip(names, same))), names


@dataclass
class Load:
    """What one entity's load has done; `rejects` (reason, details, payload) is read from the folder it was written to."""

    name: str
    batch_id: str
    loaded_at: dt.datetime
    read: int = 0
    rejected: int = 0
    merged: int = 0
    newest: dt.datetime | None = None
    rejects: DataFrame | None = None
    error: str | None = None
    counts: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.counts = {"read": self.read, "rejected": self.rejected, "merged": self.merged}


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _same_thing(name: str, row: str) -> Column:
    """The business key of a struct's row as 128 bits of a digest; null keys are equal."""
    names = [f"_{i}" for i in range(len(business_key(name)))]
    columns = {"payment": "customer_id payment_type amount payment_date rental_id subscription_id", "streaming_session": "customer_id content_id device_id start_time", "customer": "email"}[name].split()
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"{row}.{c}").alias(n) for n, c in zip(names, columns)])), 256)
    return F.when(F.col(row).isNotNull(), F.unhex(F.substring(digest, 1, 32)))


def _unmarked() -> dict[str, Column]:
    return {"is_duplicate": F.lit(False), "duplicate_of_id": F.lit(None).cast("long")}


def _inserts(clean: DataFrame, name: str) -> DataFrame:
    """Cleansed rows as changes of an empty silver."""
    marked = clean.withColumns(_unmarked())
    none = F.lit(None).cast(marked.select(F.struct("*").alias("r")).schema["r"].dataType)
    return marked.select(*key_of(name), F.lit("insert").alias("action"), none.alias("old"), F.struct(*marked.columns).alias("new"))


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    def buckets(self, total: int) -> int:
        """How many buckets a table of so many rows gets."""
        return max(1, min(-(-total // self.bucket_rows), max(MANY_BUCKETS, -(-total // BUCKET_ROWS))))

    # --- control tables ---

    def control(self, name: str, schema: str) -> DataFrame:
        now = Table(self.spark, f"{self.root}/control/{name}").read()
        return self.spark.createDataFrame([], schema) if now is None else now

    def _change(self, name: str, change: Callable[[DataFrame | None], DataFrame | None]) -> None:
        """Changes a control table; begins again from the newer rows where another writer was faster."""
        Table(self.spark, f"{self.root}/control/{name}").update(change)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        """Control tables but rejects are small: a row for each run, step, batch or mark."""
        if rows:
            new = self.spark.createDataFrame(rows, schema)
            self._change(name, lambda now: (new if now is None else now.unionByName(new)).coalesce(1))

    def marks(self) -> dict[str, dt.datetime]:
        return {r["name"]: r["value"] for r in self.control("watermarks", MARKS).collect()}

    def mark(self, name: str) -> dt.datetime | None:
        return self.marks().get(name)

    def advance(self, marks: dict[str, dt.datetime]) -> None:
        if marks:
            new = self.spark.createDataFrame(list(marks.items()), MARKS)
            self._change("watermarks", lambda now: new if now is None else merges.upsert(now, new, ["name"]).coalesce(1))

    def _update_run(self, run_id: int, **values) -> None:
        def change(runs: DataFrame) -> DataFrame:
            new = [tuple(values.get(c, v) if r["run_id"] == run_id else v for c, v in r.asDict().items()) for r in runs.collect()]
            return self.spark.createDataFrame(new, RUNS).coalesce(1)

        self._change("runs", change)

    @contextmanager
    def run(self, pipeline: str, now: dt.datetime, full_refresh: bool = False, triggered_by: str = "schedule"):
        """Yields the run id; ends as SUCCEEDED, or as FAILED with the error. Steps of runs beyond the last KEEP_RUNS go."""
        run_id = (self.control("runs", RUNS).agg(F.max("run_id")).first()[0] or 0) + 1
        self._append("runs", RUNS, [(run_id, pipeline, full_refresh, triggered_by, "RUNNING", now, None, None)])
        try:
            yield run_id
        except Exception as e:
            self._update_run(run_id, status="FAILED", error=str(e)[:2000], finished_at=now)
            raise
        self._update_run(run_id, status="SUCCEEDED", finished_at=now)
        old = F.col("run_id") <= run_id - KEEP_RUNS
        self._change("steps", lambda steps: steps.where(~old).coalesce(1) if steps is not None and steps.where(old).limit(1).count() else None)

    def log_steps(self, run_id: int, steps: Iterable[tuple]) -> None:
        """(step, rows inserted, updated, deleted, seconds, note) each."""
        self._append("steps", STEPS, [(run_id, *s) for s in steps])

    def run_log(self) -> DataFrame:
        """Runs with their duration in seconds and number of steps, the newest first."""
        steps = self.control("steps", STEPS).groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("seconds").alias("step_seconds"))
        seconds = F.expr("timestampdiff(SECOND, started_at, finished_at)").alias("seconds")
        return self.control("runs", RUNS).join(steps, "run_id", "left").select("run_id", "pipeline", "status", seconds, F.coalesce("steps", F.lit(0)).alias("steps"), "step_seconds", "error").orderBy(F.desc("run_id"))

    def log_rejects(self, loads: list[Load]) -> None:
        """One row for each distinct payload and reason of a table; repeats raise its count. Rejects of all loads go in together."""
        parts = [x.rejects.select(F.lit(x.name).alias("table_name"), "reason", "details", "payload", F.lit(x.batch_id).alias("batch_id")) for x in loads if x.rejects is not None and x.rejected]
        if not parts:
            return
        new = parts[0]
        for p in parts[1:]:
            new = new.unionByName(p)
        key = F.sha2(F.concat_ws("\n", "table_name", "reason", "payload"), 256).alias("payload_hash")
        new = new.groupBy(key).agg(*[F.min(c).alias(c) for c in ("table_name", "reason", "details", "payload")], F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count("*").alias("occurrence_count"))
        keep = [F.min_by(c, "_n").alias(c) for c in ("table_name", "reason", "details", "payload", "first_batch")]

        def change(now: DataFrame | None) -> DataFrame:
            if now is None:
                return new
            # rejects that do not come again stay where they are
            again = joins.few(new.select("payload_hash"), sum(x.rejected for x in loads))
            both = now.join(again, "payload_hash", "left_semi").withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
            told = both.groupBy("payload_hash").agg(*keep, F.max_by("last_batch", "_n").alias("last_batch"), F.sum("occurrence_count").alias("occurrence_count"))
            return now.join(again, "payload_hash", "left_anti").select(told.columns).unionByName(told)

        self._change("rejects", change)

    # --- layers ---

    def silver_table(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/silver/{name}")

    def silver(self, name: str) -> DataFrame | None:
        return self.silver_table(name).read()

    def bronze(self, name: str) -> DataFrame | None:
        return Table(self.spark, f"{self.root}/bronze/{name}").read()

    def feed(self, name: str, after: dt.datetime | None = None, upto: dt.datetime | None = None, beyond: int | None = None) -> DataFrame | None:
        """The key's columns, `action`, and the structs `old` and `new` of silver rows that changed by loads in (after, upto],
        or by log entries beyond a number; `entry` is the number of the change. None: nothing changed."""
        table, found = self.silver_table(name), None
        for number in reversed(table.numbers()):
            made = table.entry(number)
            at = dt.datetime.fromisoformat(made.meta["loaded_at"])
            if (after is not None and at <= after) or (beyond is not None and number <= beyond):
                break
            if upto is None or at <= upto:
                one = self.spark.read.parquet(made.meta["feed"])
                if made.meta.get("inserted"):
                    one = _inserts(one, name)
                one = one.withColumn("entry", F.lit(number))
                found = one if found is None else found.unionByName(one)
        return found

    def without_duplicates(self, name: str, feed: DataFrame) -> DataFrame:
        """Changes of a feed but those to rows whose business key a lower id of silver has, marked or not marked yet."""
        if name not in FLAGGED:
            return feed
        (key,), n = key_of(name), feed.count()
        changed = feed.where("new IS NOT NULL").select(_same_thing(name, "new").alias("same")).distinct()
        rows = self.silver(name).select(F.col(key), F.struct("*").alias("row"))
        ids = rows.select(key, _same_thing(name, "row").alias("same")).join(joins.few(changed, n), "same", "left_semi")
        least = joins.apart(ids.groupBy("same").agg(F.min(key).alias("least")))
        later = ids.join(joins.few(feed.select(key).distinct(), n), key, "left_semi").join(least, "same").where(F.col(key) > F.col("least")).select(key)
        return feed.join(joins.few(later, n), key, "left_anti").select(feed.columns)

    def load(self, name: str, source: DataFrame, batch_id: str, loaded_at: dt.datetime, after: dt.datetime | None) -> Load:
        """Batch copy, bronze and silver of what the source has beyond `after`; control tables are left to record()."""
        key, path = key_of(name), f"{self.root}/batches/{name}/{batch_id}"
        landing = Table(self.spark, f"{self.root}/bronze/{name}")
        rows = typed_rows(not_yet_loaded(source, "updated_at", after), name)
        if after is not None:
            # of the rows with the watermark's own stamp, those that are known: by key, or as a reject
            edge, stamp = F.col("updated_at").eqNullSafe(F.lit(after)), F.lit(after).cast("timestamp_ntz")
            known = self._landed_between(landing, after, after, other_than=batch_id)
            if known is not None:
                # whole rows stay where they are if those with that stamp which are not known are few: only keys move
                keyed = F.expr(" AND ".join(f"{k} IS NOT NULL" for k in key))
                fresh = rows.where(edge & keyed).select(*key).join(joins.apart(known.where(F.col("updated_at") == stamp).select(*key)), key, "left_anti").distinct()
                packed(fresh.write.mode("overwrite")).parquet(f"{path}/fresh")
                fresh = self.spark.read.schema(fresh.schema).parquet(f"{path}/fresh").withColumn("_fresh", F.lit(True))
                rows = rows.join(joins.few(fresh, fresh.count()), key, "left").where(~edge | ~keyed | F.col("_fresh").isNotNull()).select(rows.columns)
            refused = self.control("rejects", REJECTS).where((F.col("table_name") == name) & (F.col("last_batch") != batch_id)).select(F.col("payload").alias("_p"))
            rows = rows.join(joins.apart(refused), edge & (F.col("payload") == F.col("_p")), "left_anti")
        packed(rows.write.mode("overwrite")).parquet(f"{path}/typed")
        batch = self.spark.read.parquet(f"{path}/typed")
        seen = batch.agg(F.count("*"), F.max("updated_at"), F.min("updated_at")).first()
        out = Load(name, batch_id, loaded_at, read=seen[0], newest=seen[1])
        if not out.read and self.silver_table(name).numbers():
            return out

        order = [F.desc("updated_at"), F.col("payload")]
        whole = " AND ".join(f"{k} IS NOT NULL" for k in (*key, "updated_at"))
        # most rows are the only ones of their key, and stay where they are
        twice = joins.repeated(batch.where(" AND ".join(f"{k} IS NOT NULL" for k in key)), key)
        landed = joins.first_of_repeated(batch.where(whole), twice, key, [*key, "updated_at"], order).drop("payload", "details")
        known = self._landed_between(landing, seen[2], seen[1], other_than=batch_id)
        if known is not None:
            landed = landed.join(joins.apart(known.select(*key, "updated_at")), [*key, "updated_at"], "left_anti").select(landed.columns)
        self._land(landing, landed.withColumns({"_batch_id": F.lit(batch_id), "_loaded_at": F.lit(loaded_at)}), batch_id, seen[2], seen[1])

        # versions of one row are no duplicates of each other
        valid, invalid = joins.first_of_repeated(batch.where("details = ''"), twice, key, key, order), batch.where("details <> ''").select(F.lit("VALIDATION").alias("reason"), "details", "payload")
        if business_key(name):
            rows, names = _keyed(valid, name)
            same = joins.ranked_duplicates(rows.select(key[0], *names), names, key[0]).where("is_duplicate").select(key[0], "duplicate_of_id")
            packed(same.write.mode("overwrite")).parquet(f"{path}/same")
            # a row that silver has under another business key is no new duplicate: it takes its new values there and is marked
            new = self._with_known(self.spark.read.parquet(f"{path}/same"), name).where("NOT _known").drop("_known")
            if n := new.count():
                again = valid.join(joins.few(new, n), key).select(F.lit("DUPLICATE").alias("reason"), F.concat(F.lit("same as "), F.col("duplicate_of_id").cast("string")).alias("details"), "payload")
                valid, invalid = valid.join(joins.few(new.select(key), n), key, "left_anti").select(valid.columns), invalid.unionByName(again)
        folder = f"{self.root}/rejected/{name}/{batch_id}"
        invalid.write.mode("overwrite").option("compression", "gzip").json(folder)
        out.rejects = self.spark.read.schema("reason string, details string, payload string").json(folder)
        out.rejected = out.rejects.count()

        # the rows of a first load are its feed as well, so a later try of the batch must not take their place
        folder = f"{path}/clean" if self.silver_table(name).numbers() else f"{path}/first-{uuid.uuid4().hex}"
        packed(cleansed(valid, name).withColumns({"_batch_id": F.lit(batch_id), "_loaded_at": F.lit(loaded_at)}).write.mode("overwrite")).parquet(folder)
        out.merged = self.merge_silver(name, self.spark.read.parquet(folder), batch_id, loaded_at, folder)
        out.__post_init__()
        return out

    def _with_known(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with `_known`: silver has a row of the key."""
        key, table = key_of(name), self.silver_table(name)
        state = table.state()
        if state is None:
            return rows.withColumn("_known", F.lit(False))
        touched = [r[0] for r in rows.select(bucket(key, state.meta["buckets"])).distinct().collect()]  # as many as buckets at most
        there = table.read(touched, state).select(*key, F.lit(True).alias("_there"))
        return rows.join(joins.apart(there), key, "left").withColumn("_known", F.coalesce("_there", F.lit(False))).drop("_there")

    def _landed_between(self, landing: Table, low: dt.datetime | None, high: dt.datetime | None, other_than: str) -> DataFrame | None:
        """Rows of the batches in bronze whose stamps can lie from low to high. Other batches' files are not touched."""
        state = landing.state()
        if state is None or low is None:
            return None
        spans = state.meta["spans"]
        near = [b for b, (a, z) in spans.items() if b != other_than and a <= high.isoformat() and z >= low.isoformat()]
        return landing.read([state.meta["places"][b] for b in near], state) if near else None

    def _land(self, landing: Table, rows: DataFrame, batch_id: str, low: dt.datetime | None, high: dt.datetime | None) -> None:
        """A part of bronze for a batch, which takes the place of an earlier try of it."""
        while True:
            state = landing.state()
            meta = state.meta if state else {"places": {}, "spans": {}}
            place = meta["places"].get(batch_id, len(meta["places"]))
            spans = meta["spans"] | ({batch_id: (low.isoformat(), high.isoformat())} if low else {})
            new = {"places": meta["places"] | {batch_id: place}, "spans": spans}
            try:
                if state is None:
                    landing.replace(rows, F.lit(place), new)
                else:
                    landing.replace_parts(rows, F.lit(place), [place], state, new)
                return
            except Conflict:
                continue

    def merge_silver(self, name: str, clean: DataFrame, batch_id: str, loaded_at: dt.datetime, folder: str | None = None) -> int:
        """Upserts cleansed rows, one for each key, into silver; the number of rows there that this batch has made. `folder`:
        where the rows lie for good, which spares a copy of them where all are inserted.

        Only the buckets of the batch's keys are read and written. An identical row changes nothing, not even its stamps.
        The batch meets the buckets by a semi and an anti join with the batch on the small side, so that Spark can send the
        batch to the buckets and need not move them.
        """
        key, table = key_of(name), self.silver_table(name)
        while True:
            state = table.state()
            if state is None and folder is not None:
                total = clean.count()
                buckets = self.buckets(total)
                by = bucket(key, buckets)
                rows = clean.withColumns(_unmarked()).withColumn("_part", by).repartition(buckets, "_part")
                try:
                    table.replace(rows, F.col("_part"), {"rows": total, "feed": folder, "inserted": True, "loaded_at": loaded_at.isoformat(), "buckets": buckets})
                    return total
                except Conflict:
                    continue
            if state is None:
                changes = _inserts(clean, name)
            else:
                buckets = state.meta["buckets"]
                touched = [r[0] for r in clean.select(bucket(key, buckets)).distinct().collect()]  # as many as buckets at most
                current = table.read(touched, state)
                old = current.join(clean.select(key), key, "left_semi").select(*key, F.struct(*current.columns).alias("old"))
                both = clean.join(old, key, "left")
                compared = [c for c in clean.columns if c not in key and c not in STAMPED]
                same = F.lit(True)
                for c in compared:
                    same = same & F.col(c).eqNullSafe(F.col(f"old.{c}"))
                kept = {"is_duplicate": F.coalesce("old.is_duplicate", F.lit(False)), "duplicate_of_id": F.col("old.duplicate_of_id")}
                new = F.struct(*[kept[c].alias(c) if c in kept else F.col(c) for c in current.columns])
                action = F.when(F.col("old").isNull(), "insert").otherwise("update")
                changes = both.where(F.col("old").isNull() | ~same).select(*key, action.alias("action"), "old", new.alias("new"))
            if self._change_silver(name, table, state, changes, loaded_at) is not None:
                break
        now = table.state()
        touched = [r[0] for r in clean.select(bucket(key, now.meta["buckets"])).distinct().collect()]
        return table.read(touched, now).where(F.col("_batch_id") == batch_id).count()

    def _change_silver(self, name: str, table: Table, state: Commit | None, changes: DataFrame, loaded_at: dt.datetime) -> int | None:
        """Puts changed rows in the place of old ones, and the feed of them beside; how many, or None if another writer was
        faster. `changes`: key, action, old and new."""
        key = key_of(name)
        path = f"{self.root}/changes/{name}/{uuid.uuid4().hex}"
        packed(changes.write).parquet(path)
        feed = self.spark.read.parquet(path)
        told = {r["action"]: r["count"] for r in feed.groupBy("action").count().collect()}
        n = sum(told.values())
        if not n and state is not None:
            return 0
        rows = feed.select("new.*")
        total = told.get("insert", 0) + (state.meta["rows"] if state else 0)
        meta = {"rows": total, "feed": path, "inserted": False, "loaded_at": loaded_at.isoformat()}
        buckets = state.meta["buckets"] if state else 0
        try:
            if state is None or self.buckets(total) > 4 * buckets:
                buckets = self.buckets(total)
                by = bucket(key, buckets)
                if state is not None:
                    rows = table.read(state=state).join(feed.select(key), key, "left_anti").unionByName(rows)
                table.replace(rows.repartition(buckets, by), by, meta | {"buckets": buckets})
            else:
                by = bucket(key, buckets)
                touched = [r[0] for r in feed.select(by).distinct().collect()]
                # old and new rows of a bucket meet in the task that writes it, so that they move once and make one file
                both = table.read(touched, state).withColumn("_o", F.lit(1)).unionByName(rows.withColumn("_o", F.lit(0)))
                both = both.withColumn("_part", by).repartition("_part")
                table.replace_parts(joins.first_of(both, ["_part", *key], [F.col("_o")]).drop("_o"), F.col("_part"), touched, state, meta)
        except Conflict:
            return None
        return n

    def record(self, loads: list[Load]) -> None:
        """Rejects, failures and audit of loads, then their watermarks: a load that broke off is read again."""
        good = [x for x in loads if x.error is None]
        self.log_rejects(good)
        self._append("failed", FAILED, [(x.batch_id, x.name, x.error, x.loaded_at) for x in loads if x.error is not None])
        self._append("audit", AUDIT, [(x.batch_id, layer, x.name, n, x.loaded_at) for x in good for layer, n in (("bronze", x.read), ("silver", x.merged))])
        self.advance({x.name: x.newest for x in good if x.newest is not None})

    def ingest(self, name: str, source: DataFrame, batch_id: str, loaded_at: dt.datetime) -> dict[str, int]:
        """Loads what the source has beyond the table's watermark. Returns rows read, rejected and merged into silver."""
        done = self.load(name, source, batch_id, loaded_at, self.mark(name))
        self.record([done])
        return done.counts

    def ingest_all(self, sources: dict[str, DataFrame], batch_id: str, loaded_at: dt.datetime, side_by_side: int = 8, tries: int = 2, wait: float = 1.0) -> list[Load]:
        """Loads all sources, several at a time. A load that fails is tried again after `wait` seconds, then twice as many,
        and so on. If it fails for good the others still count, its error is kept in the table of failed batches, what could
        be read of its rows in failed/, and its watermark stays where it was."""
        marks = self.marks()

        def one(name: str) -> Load:
            error = ""
            for n in range(tries):
                try:
                    return self.load(name, sources[name], batch_id, loaded_at, marks.get(name))
                except Exception as e:  # noqa: BLE001  kept in the control table
                    error = f"{type(e).__name__}: {e}"[:2000]
                    if n < tries - 1:
                        time.sleep(wait * 2**n)
            try:
                not_yet_loaded(sources[name], "updated_at", marks.get(name)).write.mode("overwrite").json(f"{self.root}/failed/{name}/{batch_id}")
            except Exception as e:  # noqa: BLE001  the source itself cannot be read
                error = f"{error}\nnot kept: {type(e).__name__}"[:2000]
            return Load(name, batch_id, loaded_at, error=error)

        with ThreadPoolExecutor(side_by_side) as pool:
            loads = list(pool.map(one, sorted(sources)))
        self.record(loads)
        return loads

    def flag_silver(self, loaded_at: dt.datetime) -> int:
        """Marks all but the lowest id of each business key, across batches; the number of rows whose mark has changed. Rows
        whose mark changes count as loaded anew."""
        return sum(self._flag(name, loaded_at) for name in FLAGGED if self.silver_table(name).numbers())

    def _flag(self, name: str, loaded_at: dt.datetime) -> int:
        """An index (business key, id), in buckets by business key, takes in the rows that changed since it was last brought up
        to date. Only the business keys that these have, or had before, are marked anew: the lowest id of a key that was
        left may now be another's, and a row may have left a key that others still share. What a later load has to mark is
        few rows as a rule, and goes to the buckets then: these are moved only where they are written anew."""
        (key,), table, index = key_of(name), self.silver_table(name), Table(self.spark, f"{self.root}/control/same_key_{name}")
        known = index.state()
        feed = self.feed(name, beyond=known.meta["silver"] if known else 0)
        if feed is None:
            return 0
        moves = feed.select(F.col(key).alias("id"), _same_thing(name, "old").alias("left"), _same_thing(name, "new").alias("same"), "entry")
        upto = table.numbers()[-1]
        one = known is None and table.numbers() == [1]  # a first load has an id once, and marks nothing
        latest = moves.select("id", "same") if one else moves.groupBy("id").agg(F.max_by("same", "entry").alias("same"))
        buckets = known.meta["buckets"] if known else table.state().meta["buckets"]
        by = bucket(["same"], buckets)
        if known is None:
            touched, entries = None, latest
            index.replace(entries.withColumn("_part", by).repartition(buckets, "_part"), F.col("_part"), {"buckets": buckets, "silver": 0})
            if one and index.read().groupBy("same").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                index.note(index.state(), silver=upto)
                return 0
            asked = joins.apart(latest.select("same").distinct())
        else:
            n = feed.count()
            asked = moves.select(F.explode(F.array("left", "same")).alias("same")).where("same IS NOT NULL").distinct()
            touched = [r[0] for r in asked.select(by).distinct().collect()]
            entries = index.read(touched, known).join(joins.few(latest.select("id"), n), "id", "left_anti").select("id", "same").unionByName(latest)
            index.replace_parts(entries.repartition(by), by, touched, known)
            asked = joins.few(asked, 2 * n)
        entries = index.read(touched).join(asked, "same", "left_semi")
        # one business key can be that of many rows, so that entries are counted themselves
        meet = joins.apart if known is None else lambda rows, n=entries.count(): joins.few(rows, n)
        lowest = entries.groupBy("same").agg(F.min("id").alias("least"))
        marks = entries.join(meet(lowest), "same").select(F.col("id").alias(key), (F.col("id") > F.col("least")).alias("_dup"), F.when(F.col("id") > F.col("least"), F.col("least")).alias("_of"))
        moved = 0
        while True:
            state = table.state()
            if known is None:
                current = table.read(state=state)
            else:
                current = table.read([r[0] for r in marks.select(bucket([key], state.meta["buckets"])).distinct().collect()], state)
            j = current.join(meet(marks), key).where(~(F.col("is_duplicate").eqNullSafe(F.col("_dup")) & F.col("duplicate_of_id").eqNullSafe(F.col("_of"))))
            anew = {"is_duplicate": F.col("_dup"), "duplicate_of_id": F.col("_of"), "_loaded_at": F.lit(loaded_at)}
            new = F.struct(*[anew[c].alias(c) if c in anew else F.col(c) for c in current.columns])
            done = self._change_silver(name, table, state, j.select(key, F.lit("flag").alias("action"), F.struct(*current.columns).alias("old"), new.alias("new")), loaded_at)
            if done is not None:
                moved = done
                break
        index.note(index.state(), silver=upto)
        return moved


#: Where a row's days are: months of customers' activity, and months of titles.
DAYS = {"streaming_session": ("start_time",), "rental": ("rental_date", "return_date"), "payment": ("payment_date",), "support_ticket": ("opened_date",), "review": ("review_date",), "wishlist": ("added_date",)}
MONTH_COLUMNS = {"streaming_session": "start_time", "rental": "rental_date", "payment": "payment_date", "review": "review_date", "wishlist": "added_date"}


def _month(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _images(feed: DataFrame) -> DataFrame:
    """Rows as they were and as they are."""
    return feed.where("old IS NOT NULL").select("old.*").unionByName(feed.where("new IS NOT NULL").select("new.*"))


def change_feed(feeds: dict[str, DataFrame]) -> DataFrame:
    """One row for each change: table, key, action, and customer, item, title and month before and after it."""
    out = []
    for name, feed in sorted(feeds.items()):
        kind = feed.schema["new"].dataType

        def of(image: str, *columns: str) -> Column:
            found = next((c for c in columns if c in kind.names), None)
            return F.col(f"{image}.{found}").cast("long") if found else F.lit(None).cast("long")

        def month(image: str) -> Column:
            return _month(F.col(f"{image}.{MONTH_COLUMNS[name]}")) if name in MONTH_COLUMNS else F.lit(None).cast("int")

        sides = [c.alias(f"{image}_{n}") for image in ("old", "new") for n, c in (("customer", of(image, "customer_id")), ("item", of(image, "inventory_id")), ("content", of(image, "content_id")), ("month", month(image)))]
        out.append(feed.select(F.lit(name).alias("table_name"), F.concat_ws("/", *[F.col(k).cast("string") for k in key_of(name)]).alias("row_key"), "action", *sides))
    return _union(out)


def change_set(feeds: dict[str, DataFrame], silver: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What the facts must build anew, from rows as they were and as they are.

    `customer`: customer_id and month_key with activity that changed; `month`: months of titles; `inventory`: inventory_id
    and the day from which its snapshots change (null: from the first). What changes in dimensions comes on top
    (runner.dimension_changes). A row whose facts read the same as before changes nothing.
    """
    customers, months, items = [], [], []
    for t, feed in feeds.items():
        both = _images(feed)
        for day in DAYS.get(t, ()):
            customers.append(both.where(F.col(day).isNotNull()).select("customer_id", _month(F.col(day)).alias("month_key")))
        if t in MONTH_COLUMNS:
            months.append(both.select(_month(F.col(MONTH_COLUMNS[t])).alias("month_key")))
    if (feed := feeds.get("customer_subscription")) is not None:
        # a plan counts from its start, to its end
        span = F.struct(F.trunc("start_date", "month").alias("a"), F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("z"))
        on = _images(feed).select("customer_id", span.alias("s"))
        days = [silver[t].select("customer_id", F.explode(F.array(*[F.trunc(d, "month") for d in DAYS[t]])).alias("d")) for t in DAYS if t in silver]
        active = _union([d.join(joins.apart(on.select("customer_id").distinct()), "customer_id", "left_semi") for d in days]).where("d IS NOT NULL").distinct()
        customers.append(active.join(joins.apart(on), "customer_id").where("d BETWEEN s.a AND s.z").select("customer_id", _month(F.col("d")).alias("month_key")))
    if (feed := feeds.get("rental")) is not None:
        o, n = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
        alike = F.lit(True)
        for c in ("inventory_id", "rental_date", "due_date"):
            alike = alike & o(c).eqNullSafe(n(c))
        # a return alone changes the days from the earlier of both returns on; without a change of it there is none
        back = F.when(~o("return_date").eqNullSafe(n("return_date")), F.least(o("return_date"), n("return_date")))
        begin = F.when(alike, back).otherwise(F.least(o("rental_date"), n("rental_date")))
        moved = feed.select(F.explode(F.array(o("inventory_id"), n("inventory_id"))).alias("inventory_id"), begin.alias("from_date"))
        moved = moved.where("inventory_id IS NOT NULL AND from_date IS NOT NULL")
        if "inventory_item" in silver:
            # a retired item stays up to its last loan, so that a loan that comes, goes or moves also changes days before it: from
            # the end of the last of its other loans, or from the first where it has none. One that is out keeps it there anyway.
            gone = silver["inventory_item"].where("status = 'Retired'").select("inventory_id").join(joins.apart(moved.select("inventory_id").distinct()), "inventory_id", "left_semi")
            last = silver["rental"].select("rental_id", "inventory_id", F.date_add(F.greatest("rental_date", F.coalesce("return_date", F.lit("9999-12-30").cast("date"))), 1).alias("_end"))
            last = last.join(joins.apart(gone), "inventory_id", "left_semi").join(joins.apart(feed.select("rental_id")), "rental_id", "left_anti").groupBy("inventory_id").agg(F.max("_end").alias("_end"))
            gone = gone.join(joins.apart(last), "inventory_id", "left").select("inventory_id", F.lit(True).alias("_gone"), "_end")
            since = F.when(F.col("_gone").isNull(), F.col("from_date")).when(F.col("_end").isNotNull(), F.least("from_date", "_end"))
            moved = moved.join(joins.apart(gone), "inventory_id", "left").select("inventory_id", since.alias("from_date"))
        items.append(moved)
        carried = feed.where(~o("inventory_id").eqNullSafe(n("inventory_id"))).select("rental_id")
        if "payment" in silver:
            months.append(silver["payment"].join(joins.apart(carried), "rental_id", "left_semi").select(_month(F.col("payment_date")).alias("month_key")))
    if (feed := feeds.get("inventory_item")) is not None:
        other = ~F.col("old.content_id").eqNullSafe(F.col("new.content_id")) | ~F.col("old.purchase_date").eqNullSafe(F.col("new.purchase_date"))
        items.append(feed.where(F.col("old").isNull() | other).select("inventory_id", F.lit(None).cast("date").alias("from_date")))
        moved = feed.where(~F.col("old.content_id").eqNullSafe(F.col("new.content_id"))).select("inventory_id")
        rented = silver["rental"].join(joins.apart(moved), "inventory_id", "left_semi") if "rental" in silver else None
        if rented is not None:
            months.append(rented.select(_month(F.col("rental_date")).alias("month_key")))
            if "payment" in silver:
                months.append(silver["payment"].join(joins.apart(rented.select("rental_id")), "rental_id", "left_semi").select(_month(F.col("payment_date")).alias("month_key")))
    spark = next(iter(silver.values())).sparkSession
    nothing = lambda schema: spark.createDataFrame([], schema)
    found = _union([nothing("inventory_id long, from_date date"), *items]).groupBy("inventory_id").agg(F.min(F.coalesce("from_date", F.lit("0001-01-01").cast("date"))).alias("from_date"))
    return {
        "customer": _union([nothing("customer_id long, month_key int"), *customers]).where("customer_id IS NOT NULL").distinct(),
        "month": _union([nothing("month_key int"), *months]).where("month_key IS NOT NULL").distinct(),
        "inventory": found.select("inventory_id", F.nullif("from_date", F.lit("0001-01-01").cast("date")).alias("from_date")),
    }
