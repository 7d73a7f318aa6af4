"""One run over all layers: extract to silver, prepare, dimensions, facts, finalize; and what a run leaves to look at.

A gold build covers what silver has loaded since the last one that succeeded. Its window, change set and calendar are
prepared first and kept under the run's id; the watermark moves last, so a build that broke off is built again. A build
without changes writes no dimension and no fact. Facts lie in a part for each month; a build writes the months in which
something changes and leaves the files of the others alone.
"""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans import gold, views
from sedimenta.plans.entities import NAMES
from sedimenta.plans.medallion import DAYS, Load, Warehouse, _union, change_set
from sedimenta.sources.versions import Table, packed, small_broadcasts

WINDOWS = "run_id long, full_refresh boolean, watermark_from timestamp_ntz, watermark_to timestamp_ntz, snapshot_start date, snapshot_end date, previous_snapshot_end date"
MARK = "gold_build"
#: The calendar that is always there, and how far it goes beyond the last business day.
CALENDAR, BEYOND = (dt.date(2018, 1, 1), dt.date(2030, 12, 31)), 365
DIMENSIONS = ("subscription_plan", "warehouse", "content", "customer", "inventory_item")
FACTS = ("customer_daily_activity", "content_monthly_performance", "inventory_daily_snapshot")


@dataclass
class Window:
    """What one gold build covers: rows loaded in (after, upto], and snapshot days from first to last."""

    full: bool
    after: dt.datetime | None
    upto: dt.datetime | None
    first: dt.date | None
    last: dt.date | None
    previous_end: dt.date | None
    previous_first: dt.date | None = None


def gold_table(w: Warehouse, name: str) -> Table:
    return Table(w.spark, f"{w.root}/gold/{name}")


def silver_tables(w: Warehouse) -> dict[str, DataFrame]:
    return {n: d for n in NAMES if (d := w.silver(n)) is not None}


def star(w: Warehouse) -> dict[str, DataFrame]:
    """Dimensions and facts by name, as far as they are built."""
    return {n: d for n in (*DIMENSIONS, *FACTS, "date", "month") if (d := gold_table(w, n).read()) is not None}


def window_of(w: Warehouse, silver: dict[str, DataFrame], full_refresh: bool) -> Window:
    """The change window and the snapshot window, which runs from the first to the last business day in silver."""
    before = w.mark(MARK)
    full = full_refresh or before is None
    stamped = [w.silver_table(t).state().meta["loaded_at"] for t in silver]
    upto = max(map(dt.datetime.fromisoformat, stamped), default=None)
    days = [
        silver["rental"].agg(F.min("rental_date").alias("a"), F.max(F.greatest("rental_date", "return_date")).alias("b")),
        silver["streaming_session"].agg(F.min("start_time").cast("date").alias("a"), F.max("start_time").cast("date").alias("b")),
        silver["payment"].agg(F.max("payment_date").cast("date").alias("a"), F.max("payment_date").cast("date").alias("b")),
    ]
    first, last = _union(days).agg(F.min("a"), F.max("b")).first()
    done = w.control("windows", WINDOWS).join(w.control("runs", "run_id long, status string").where("status = 'SUCCEEDED'").select("run_id"), "run_id", "left_semi")
    previous = done.agg(F.max_by("snapshot_end", "run_id"), F.max_by("snapshot_start", "run_id")).first()
    return Window(full, None if full else before, upto or before, first, last, *((None, None) if full else previous))


def ensure_calendar(w: Warehouse, silver: dict[str, DataFrame], last: dt.date | None) -> int:
    """Adds the days that a dimension or fact can refer to and the calendar lacks; the number of days added."""
    low = _union([silver["inventory_item"].agg(F.min("purchase_date").alias("d")), silver["customer"].agg(F.min("registration_date").alias("d"))]).agg(F.min("d")).first()[0]
    high = max([CALENDAR[1], *([last + dt.timedelta(BEYOND)] if last else [])])
    wanted = gold.dim_date(w.spark, min([CALENDAR[0], *([low] if low else [])]), high)
    now = gold_table(w, "date").read()
    new = wanted if now is None else wanted.join(now.select("date_key"), "date_key", "left_anti")
    added = new.count()
    if added:
        both = new if now is None else now.unionByName(new)
        gold_table(w, "date").replace(both.coalesce(1))
        gold_table(w, "month").replace(gold.dim_month(gold_table(w, "date").read()).coalesce(1))
    return added


def prepare(w: Warehouse, run_id: int, now: dt.datetime, full_refresh: bool = False) -> tuple[Window, dict[str, DataFrame], dict[str, DataFrame], tuple]:
    """Flags duplicates and keeps window, calendar and change set; gives window, silver, changed keys, and the step's log."""
    began = time.time()
    flagged = w.flag_silver(now)
    silver = silver_tables(w)
    win = window_of(w, silver, full_refresh)
    w._append("windows", WINDOWS, [(run_id, win.full, win.after, win.upto, win.first, win.last, win.previous_end)])
    days = ensure_calendar(w, silver, win.last)
    feeds = {n: f for n in silver if (f := w.feed(n, win.after, win.upto)) is not None}
    changed = {} if win.full else {e: _kept(w, run_id, e, d) for e, d in change_set(feeds, silver).items()}
    n = sum(d.count() for d in changed.values())
    note = f"window ({win.after}, {win.upto}]; {n} changed keys; snapshot {win.first}..{win.last}; full_refresh={win.full}"
    return win, silver, changed, ("gold_prepare", days, flagged, 0, time.time() - began, note)


def _kept(w: Warehouse, run_id: int, entity: str, keys: DataFrame) -> DataFrame:
    path = f"{w.root}/control/change_set/run_id={run_id}/{entity}"
    packed(keys.write.mode("overwrite")).parquet(path)
    return w.spark.read.parquet(path)


def _more(w: Warehouse, run_id: int, entity: str, keys: DataFrame, more: list[DataFrame]) -> DataFrame:
    """keys with what changed dimensions add; of several days of an item the first counts, and null is before all."""
    if not more:
        return keys
    both = _union([keys, *[m.select(*[F.col(f.name).cast(f.dataType) for f in keys.schema]) for m in more]])
    if entity == "inventory":
        first = F.lit("0001-01-01").cast("date")
        both = both.groupBy("inventory_id").agg(F.min(F.coalesce("from_date", first)).alias("from_date")).select("inventory_id", F.nullif("from_date", first).alias("from_date"))
    return _kept(w, run_id, f"{entity}-all", both.distinct())


def _months(first: dt.date, last: dt.date) -> list[int]:
    n = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [i // 12 * 100 + i % 12 + 1 for i in n]


def build_dimension(w: Warehouse, silver: dict[str, DataFrame], name: str) -> tuple[tuple, DataFrame | None]:
    """A new version where a member changed; special members are seeded once. Gives the step's log, and the version before."""
    began, table = time.time(), gold_table(w, name)
    current = table.read()
    surrogate, members = views.MEMBERS[name]
    # special members have no natural key and no history, so the builders do not see them
    new = getattr(gold, f"dim_{name}")(silver, None if current is None else current.where(F.col(surrogate) > 0), lambda rows: _rewritten(w, f"control/members/{name}", rows))
    new = views.with_members(new.drop("action"), surrogate, members)
    if current is None:
        table.replace(new)
        return (f"dim_{name}", table.read().count(), 0, 0, time.time() - began, None), new.limit(0)
    old = current
    columns = [c for c in new.columns if c != surrogate]
    mine, theirs = F.xxhash64(*columns).alias("_new"), F.xxhash64(*columns).alias("_old")
    both = new.select(surrogate, mine).join(old.select(surrogate, theirs), surrogate, "full_outer")
    inserted, updated = both.agg(F.count_if(F.col("_old").isNull()), F.count_if(F.col("_old") != F.col("_new"))).first()
    if inserted or updated:
        table.replace(new)
    return (f"dim_{name}", inserted, updated, 0, time.time() - began, None), current if inserted or updated else None


def _rewritten(w: Warehouse, place: str, rows: DataFrame) -> DataFrame:
    """rows, written in the place of those of an earlier build and read back."""
    path = f"{w.root}/{place}"
    packed(rows.write.mode("overwrite")).parquet(path)
    return w.spark.read.schema(rows.schema).parquet(path)


def dimension_changes(w: Warehouse, silver: dict[str, DataFrame], before: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
    """What the facts must build anew because their dimensions changed; `before`: the dimensions that did, as they were.

    Versions that are new, or hold on other days or with other attributes that facts read, touch their customer's or item's
    days from there on. Members that facts could not find before touch the rows that stand on the missing member.
    """
    out: dict[str, list[DataFrame]] = {"customer": [], "month": [], "inventory": []}

    def new_members(name: str, key: str) -> DataFrame:
        return gold_table(w, name).read().select(key).where(f"{key} IS NOT NULL").join(before[name].select(key), key, "left_anti")

    def moved_versions(name: str, key: str, read: list[str]) -> DataFrame:
        surrogate = views.MEMBERS[name][0]
        columns = [surrogate, key, "effective_from", "effective_to", *read]
        now = gold_table(w, name).read().select(F.struct(*columns).alias("n"), F.col(surrogate).alias("k"))
        was = before[name].select(F.struct(*columns).alias("o"), F.col(surrogate).alias("k"))
        j = now.join(was, "k", "left")
        same = F.lit(True)
        for c in (key, "effective_from", *read):
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        shorter = F.date_add(F.least("n.effective_to", "o.effective_to"), 1)
        begin = F.when(same, F.when(F.col("n.effective_to") != F.col("o.effective_to"), shorter)).otherwise(F.least("n.effective_from", "o.effective_from"))
        return j.select(F.col(f"n.{key}").alias(key), begin.alias("from_date")).where(f"{key} IS NOT NULL AND from_date IS NOT NULL")

    facts = {n: gold_table(w, n) for n in FACTS}
    if "customer" in before:
        # months in which the customer has rows; a month without rows has none to change
        days = [silver[t].select("customer_id", F.explode(F.array(*[F.col(c).cast("date") for c in columns])).alias("d")) for t, columns in DAYS.items() if t in silver]
        moved = moved_versions("customer", "customer_id", []).groupBy("customer_id").agg(F.min("from_date").alias("from_date"))
        on = _union(days).join(moved, "customer_id").where("d >= from_date")
        out["customer"].append(on.select("customer_id", gold.month_key(F.col("d")).alias("month_key")))
    if "subscription_plan" in before and (fact := facts[FACTS[0]].read(with_part=True)) is not None:
        who = silver["customer_subscription"].join(new_members("subscription_plan", "plan_id"), "plan_id", "left_semi").select("customer_id")
        lost = fact.where("subscription_plan_key = -1").select("customer_id", F.col("_part").alias("month_key"))
        out["customer"].append(lost.join(who, "customer_id", "left_semi"))
    if "content" in before and (fact := facts[FACTS[1]].read()) is not None:
        found = new_members("content", "content_id")
        out["month"].append(fact.where("content_key = -1").join(found, "content_id", "left_semi").select("month_key"))
        out["inventory"].append(silver["inventory_item"].join(found, "content_id", "left_semi").select("inventory_id", F.lit(None).cast("date").alias("from_date")))
    if "inventory_item" in before:
        out["inventory"].append(moved_versions("inventory_item", "inventory_id", ["item_status", "warehouse_id"]))
    if "warehouse" in before and (items := gold_table(w, "inventory_item").read()) is not None:
        out["inventory"].append(items.join(new_members("warehouse", "warehouse_id"), "warehouse_id", "left_semi").select("inventory_id", F.col("effective_from").alias("from_date")))
    return out


def build_fact(w: Warehouse, win: Window, silver: dict[str, DataFrame], changed: dict[str, DataFrame], name: str) -> tuple:
    """Changed rows give way to new ones, month by month; a full refresh builds all of them. Gives the step's log."""
    began, table, dims = time.time(), gold_table(w, name), star(w)
    state = None if win.full else table.state()
    snapshots = name == FACTS[2]
    # days that are taken back, or put before the first, touch every item
    whole = state is None or (snapshots and (win.previous_end is None or win.last < win.previous_end or win.first != win.previous_first))
    month = F.expr("date_key div 100") if snapshots else F.col("month_key")
    if whole:
        only = None
    elif snapshots:
        only = gold.snapshot_targets(silver["inventory_item"], changed["inventory"], win.first, win.previous_end, win.last)
    else:
        only = changed["customer" if name == FACTS[0] else "month"]
    if name == FACTS[0]:
        rebuilt = gold.customer_daily_activity(silver, dims["customer"], dims["subscription_plan"], dims["date"], only)
    elif name == FACTS[1]:
        rebuilt = gold.content_monthly_performance(silver, dims["content"], only)
    else:
        rebuilt = gold.inventory_daily_snapshot(silver, dims["inventory_item"], dims["content"], dims["warehouse"], win.first, win.last, only)
    columns = [c for c in rebuilt.columns if c != "month_key" or name == FACTS[1]]
    if whole:
        old = 0 if table.state() is None else table.read().count()
        table.replace(rebuilt.select(*columns, month.alias("_part")), F.col("_part"))
        return f"fact_{name}", table.read().count(), 0, old, time.time() - began, "all months"
    if snapshots:
        begin = only.agg(F.min("from_date")).first()[0]
        months = [] if begin is None else _months(begin, win.last)
    else:
        months = [r[0] for r in only.select("month_key").distinct().collect()]  # a row for each month
    if not months:
        return f"fact_{name}", 0, 0, 0, time.time() - began, "nothing changed"
    current = table.read(months, state, with_part=True)
    if name == FACTS[0]:
        on, changed_keys = ["customer_id", "_part"], only.withColumnRenamed("month_key", "_part")
    elif name == FACTS[1]:
        on, changed_keys = ["_part"], only.withColumnRenamed("month_key", "_part")
    else:
        changed_keys = only.select(F.col("inventory_id").alias("_i"), gold.date_key(F.col("from_date")).alias("_from"))
        on = (F.col("inventory_id") == F.col("_i")) & (F.col("date_key") >= F.col("_from"))
    deleted, before = current.join(changed_keys, on, "left_semi").count(), current.count()
    kept = current.join(changed_keys, on, "left_anti").select(*columns, "_part")
    table.replace_parts(kept.unionByName(rebuilt.select(*columns, month.alias("_part"))), F.col("_part"), months, state)
    return f"fact_{name}", table.read(months).count() - before + deleted, 0, deleted, time.time() - began, f"{len(months)} months"


def build_gold(w: Warehouse, now: dt.datetime, full_refresh: bool = False) -> list[tuple]:
    """prepare, dimensions side by side, facts side by side, finalize. Gives the steps as they are logged."""
    with small_broadcasts(w.spark), w.run(MARK, now, full_refresh) as run_id:
        win, silver, changed, step = prepare(w, run_id, now, full_refresh)
        steps = [step]
        with ThreadPoolExecutor(5) as pool:
            built = list(pool.map(lambda n: build_dimension(w, silver, n), DIMENSIONS))
            steps += [step for step, _ in built]
            if not win.full:
                more = dimension_changes(w, silver, {n: was for n, (_, was) in zip(DIMENSIONS, built) if was is not None})
                changed = {e: _more(w, run_id, e, d, more[e]) for e, d in changed.items()}
            steps += pool.map(lambda n: build_fact(w, win, silver, changed, n), FACTS)
        w.log_steps(run_id, steps)
        if win.upto is not None:
            w.advance({MARK: win.upto})
    return steps


def run_all(w: Warehouse, sources: dict[str, DataFrame], batch_id: str, now: dt.datetime, full_refresh: bool = False) -> dict[str, dict[str, int]]:
    """Everything from the sources to the facts; rows read, rejected and merged by entity, and changed rows by gold step."""
    out = {x.name: x.counts for x in extract(w, sources, batch_id, now)}
    return out | {s[0]: {"inserted": s[1], "updated": s[2], "deleted": s[3]} for s in build_gold(w, now, full_refresh)}


def extract(w: Warehouse, sources: dict[str, DataFrame], batch_id: str, now: dt.datetime) -> list[Load]:
    """The sources to bronze and silver, as a run of its own."""
    began = time.time()
    with small_broadcasts(w.spark), w.run("ingest", now) as run_id:
        loads = w.ingest_all(sources, batch_id, now)
        w.log_steps(run_id, [("ingest", sum(x.merged for x in loads), 0, 0, time.time() - began, f"{sum(x.read for x in loads)} read, {sum(x.rejected for x in loads)} rejected")])
        if bad := [x.name for x in loads if x.error]:
            raise RuntimeError(f"not loaded: {', '.join(bad)}")
    return loads
