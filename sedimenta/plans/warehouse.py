"""Composite operators of the warehouse layers over the driver's tables, as DataFrames, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import flags, initcap_any
from sedimenta.operators import fingerprints, joins, merges, quality


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.col(c).cast("date")


def _cents(c):
    return F.round(F.col(c).cast("decimal(18,2)") * 100).cast("long")


D_INITCAP = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), '')"
D_CENTS = "CAST(round(CAST({0} AS DECIMAL(18,2)) * 100) AS BIGINT)"

# --- cleansing ---


def _cleansed(customers: DataFrame) -> DataFrame:
    bal = F.col("cents")
    rules = [("SIGN_FIXED", bal < 0), ("SEGMENT_STANDARDISED", F.col("c_mktsegment") != initcap_any(F.trim("c_mktsegment"))), ("NATION_DEFAULTED", F.col("c_nationkey") == 0)]
    return customers.withColumn("cents", _cents("c_acctbal")).select("c_custkey", F.abs(bal).alias("cents"), initcap_any(F.trim("c_mktsegment")).alias("segment"), F.nullif(F.col("c_nationkey"), F.lit(0)).alias("nation_key"), flags(rules).alias("dq_flags"))


D_CLEAN = f"""SELECT c_custkey, abs(cents) AS cents, {D_INITCAP.format('trim(c_mktsegment)')} AS segment, nullif(c_nationkey, 0) AS nation_key,
  nullif(concat_ws(',', CASE WHEN cents < 0 THEN 'SIGN_FIXED' END, CASE WHEN c_mktsegment <> {D_INITCAP.format('trim(c_mktsegment)')} THEN 'SEGMENT_STANDARDISED' END, CASE WHEN c_nationkey = 0 THEN 'NATION_DEFAULTED' END), '') AS dq_flags
  FROM (SELECT *, {D_CENTS.format('c_acctbal')} AS cents FROM customer)"""


def dq_flags(spark, d):
    return _cleansed(_t(spark, d, "customer"))


def flag_histogram(spark, d):
    return _cleansed(_t(spark, d, "customer")).select(F.explode(F.split("dq_flags", ",")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def clamp_and_null_rule(spark, d):
    v = F.col("value").cast("decimal(18,4)")
    return _t(spark, d, "events").select("event_id", F.when(v > 200, None).otherwise(F.least(F.greatest(v, F.lit(5).cast("decimal(18,4)")), F.lit(100).cast("decimal(18,4)"))).cast("decimal(18,4)").alias("clean"), flags([("CAPPED", (v > 100) & (v <= 200)), ("FLOORED", v < 5), ("INVALID", v > 200)]).alias("dq_flags"))


def null_safe_row_compare(spark, d):
    c = _t(spark, d, "customer")
    new = _cleansed(c).select("c_custkey", F.col("cents").alias("n_cents"), F.col("segment").alias("n_segment"), F.col("nation_key").alias("n_nation"))
    j = c.withColumn("cents", _cents("c_acctbal")).join(new, "c_custkey")
    return j.where(~F.struct("cents", F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n")).eqNullSafe(F.struct(F.col("n_cents").alias("cents"), F.col("n_segment").alias("s"), F.col("n_nation").alias("n")))).select("c_custkey")


def validation_split(spark, d):
    o = _t(spark, d, "orders").withColumn("prio", F.nullif(F.substring("o_orderpriority", 1, 1), F.lit("4")))
    _, bad = quality.split_valid(o, [("o_orderpriority is missing", F.col("prio").isNull()), ("o_totalprice is out of range", F.col("o_totalprice") > 400000), ("prio: not an int", F.col("prio").isNotNull() & F.col("prio").try_cast("int").isNull())])
    return bad.select("o_orderkey", "details")


def dq_scorecard(spark, d):
    parts = [
        quality.scorecard(_t(spark, d, "customer"), [("customer.negative_balance", F.col("c_acctbal") < 0), ("customer.segment_case", F.col("c_mktsegment") != initcap_any(F.col("c_mktsegment")))]),
        quality.scorecard(_t(spark, d, "orders"), [("orders.no_priority", F.col("o_orderpriority") == "4-NOT SPECIFIED"), ("orders.status", ~F.col("o_orderstatus").isin("O", "F"))]),
        quality.scorecard(_t(spark, d, "lineitem"), [("lineitem.discount", ~F.col("l_discount").between(0, 0.05)), ("lineitem.zero_tax", F.col("l_tax") == 0)]),
        quality.scorecard(joins.ranked_duplicates(_t(spark, d, "events").withColumn("day", _day("ts")), ["user_id", "event_type", "day"], "event_id"), [("events.duplicates", F.col("is_duplicate"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- duplicates ---


def dedupe_keep_first(spark, d):
    e = _t(spark, d, "events").withColumn("day", _day("ts"))
    return joins.ranked_duplicates(e, ["user_id", "event_type", "day"], "event_id").select("event_id", "is_duplicate", "duplicate_of_id")


def dedupe_rejects(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id > first_id").select("doc_id", F.col("first_id").alias("duplicate_of_id"), F.lit("DUPLICATE").alias("reason"))


# --- as-of joins and snapshots ---


def _versions(o: DataFrame) -> DataFrame:
    firsts = joins.first_of(o.select(F.col("o_custkey").alias("k"), _day("o_orderdate").alias("effective_from"), F.col("o_orderkey").alias("version_order"), F.col("o_orderpriority").alias("priority")), ["k", "effective_from"], [F.col("version_order")])
    return firsts.withColumn("effective_to", F.date_sub(F.expr("lead(effective_from) over (partition by k order by effective_from)"), 1))


def scd2_asof_join(spark, d):
    e = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.date_add(_day("o_orderdate"), 20).alias("on_day"))
    return joins.asof_merge(e, _versions(_t(spark, d, "orders")), "k", "on_day").select("o_orderkey", "version_order", F.coalesce("priority", F.lit("Unknown")).alias("priority"))


def _runs(spark, d) -> DataFrame:
    """item, first, last, on_loan, overdue: runs of days that are alike, from the item's first day to the last order's.

    Items are followed by the days on which a loan begins or ends, so no join and no shuffle sees a row for each day.
    """
    loans = _t(spark, d, "orders").select(F.col("o_custkey").alias("item"), _day("o_orderdate").alias("b"), F.date_add(_day("o_orderdate"), (F.col("o_orderkey") % 14).cast("int")).alias("e"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("late"))
    window = F.broadcast(loans.agg(F.max("b").alias("hi")))  # one row
    # on loan from the first day up to the day before the return, one day at least; overlapping loans of an item count once
    ends = F.date_add(F.greatest("b", F.date_sub("e", 1)), 1)
    both = F.array(F.struct(F.col("b").alias("day"), F.lit(1).alias("n"), F.col("late")), F.struct(ends.alias("day"), F.lit(-1).alias("n"), (-F.col("late")).alias("late")))
    changes = loans.select("item", F.explode(both).alias("_")).groupBy("item", "_.day").agg(F.sum("_.n").alias("n"), F.sum("_.late").alias("late"))
    by_day = Window.partitionBy("item").orderBy("day")
    runs = changes.select("item", "day", F.lead("day").over(by_day).alias("next"), F.sum("n").over(by_day).alias("n"), F.sum("late").over(by_day).alias("late")).crossJoin(window)
    last = F.least(F.coalesce(F.date_sub("next", 1), F.col("hi")), F.col("hi"))
    return runs.select("item", F.col("day").alias("first"), last.alias("last"), (F.col("n") > 0).cast("int").alias("on_loan"), (F.col("late") > 0).cast("int").alias("overdue"))


def inventory_daily_snapshot(spark, d):
    """One row an item and day: the days of a run are spread out last."""
    return _runs(spark, d).select("item", F.explode(joins.days_between(F.col("first"), F.col("last"))).alias("day"), "on_loan", "overdue")


def warehouse_utilisation_monthly(spark, d):
    """Runs are cut at month ends and their lengths added up, by item and month first, so items need no distinct count."""
    n = _t(spark, d, "customer").select(F.col("c_custkey").alias("item"), "c_nationkey")
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    cut = _runs(spark, d).where("first <= last").select("item", "on_loan", "first", "last", F.explode(months).alias("m"))
    length = F.datediff(F.least("last", F.last_day("m")), F.greatest("first", "m")) + 1
    own = cut.groupBy("item", "m").agg(F.sum(length * F.col("on_loan")).alias("loan_days"), F.sum(length).alias("days"))
    g = own.join(n, "item").groupBy("c_nationkey", (F.year("m") * 100 + F.month("m")).cast("long").alias("month_key")).agg(F.sum("loan_days").alias("loan_days"), F.sum("days").alias("days"), F.count("*").alias("items"))
    return g.select("c_nationkey", "month_key", "loan_days", "days", "items", F.expr("(20000 * loan_days + days) div (2 * days)").alias("utilisation_bp"))


D_SNAP = """l AS (SELECT o_custkey AS item, CAST(o_orderdate AS DATE) AS b, CAST(CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 14) DAY AS DATE) AS e, o_orderpriority = '1-URGENT' AS late FROM orders),
hi AS (SELECT max(b) AS hi FROM l),
busy AS (SELECT item, day, bool_or(late) AS overdue FROM (SELECT item, late, CAST(unnest(generate_series(b, least(greatest(b, e - 1), hi), INTERVAL 1 DAY)) AS DATE) AS day FROM l, hi) x GROUP BY 1, 2),
dense AS (SELECT item, CAST(unnest(generate_series(f, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT item, min(b) AS f FROM l GROUP BY 1) i, hi),
snap AS (SELECT d.item, d.day, CAST(b.item IS NOT NULL AS INT) AS on_loan, CAST(coalesce(overdue, false) AS INT) AS overdue FROM dense d LEFT JOIN busy b ON b.item = d.item AND b.day = d.day)"""

# --- merges ---


def insert_ignore(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    batch = o.where("o_orderkey % 3 = 0").unionByName(o.where("o_orderkey % 9 = 0"))
    once = merges.insert_ignore(o.where("o_orderkey % 2 = 0"), batch, ["o_orderkey"])
    return merges.insert_ignore(once, batch, ["o_orderkey"])


def upsert_merge(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(False).alias("is_duplicate"), F.lit("b1").alias("batch_id"))
    batch = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lit("b2").alias("batch_id"))
    return merges.upsert(o.where("o_orderkey % 4 <> 1"), batch, ["o_orderkey"], stamps=["batch_id"])


def delete_insert(spark, d):
    daily = _t(spark, d, "events").groupBy("user_id", _day("ts").alias("day")).agg(F.count("*").alias("n"))
    changed = daily.where("user_id % 7 = 0").select("user_id")
    return merges.delete_insert(daily.withColumn("n", F.lit(0).cast("long")), daily.join(changed.distinct(), "user_id", "left_semi"), changed)


def scd1_merge(spark, d):
    c = _t(spark, d, "customer")
    current = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment").withColumn("customer_key", F.col("c_custkey") + 1000)
    incoming = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 1, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return merges.scd1(current, incoming, "c_custkey", "customer_key").select("c_custkey", "customer_key", "action", "c_mktsegment")


def scd2_merge(spark, d):
    c = _t(spark, d, "customer")
    first = F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-06-01")).otherwise("1900-01-01").cast("date")
    current = c.where("c_custkey % 4 <> 0").select("c_custkey", "c_mktsegment", "c_name", first.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))
    incoming = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.upper("c_name").alias("c_name"), F.lit("2024-03-15").cast("date").alias("changed_on"))
    return merges.scd2(current, incoming, "c_custkey", ["c_mktsegment"], ["c_name"], "changed_on")


def flow_rejects_json(spark, d):
    e = _t(spark, d, "events").select(F.from_json("props", "k int").alias("p"), F.md5("props").alias("h"), F.to_json(F.struct("event_type")).alias("payload"))
    items = e.select("h", "p.k", F.explode(F.from_json(F.concat(F.lit("["), "payload", F.lit("]")), "array<struct<event_type:string>>")).alias("r"))
    return items.groupBy("h", "k", F.col("r.event_type").alias("event_type")).agg(F.count("*").alias("occurrence_count")).where("occurrence_count > 1")


def change_set_rebuild(spark, d):
    """An incremental build (old facts, then the changed users rebuilt) equals a full one."""
    e = _t(spark, d, "events")
    build = lambda x: x.groupBy("user_id", _day("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    old, changed = build(e.where(F.col("ts") < cut)), e.where(F.col("ts") >= cut).select("user_id").distinct()
    return merges.delete_insert(old, build(e.join(changed, "user_id", "left_semi")), changed)


def _scratch(spark: SparkSession, tag: str) -> str:
    import uuid

    from sedimenta.plans.layers import scratch

    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def stream_upsert_events(spark, d):
    """The newest event of each user, from a stream of several triggers that brings the newest events first."""
    from sedimenta.sources.versions import Table
    from sedimenta.streaming.upserts import stream_table, upsert_stream

    base = _scratch(spark, "stream")
    events, waves = _t(spark, d, "events"), 4
    top = events.agg(F.max("event_id")).first()[0] or 0
    for wave in range(waves):  # a folder of files for each wave, the last quarter of the ids first; streams take older files first
        share = F.least(F.lit(waves - 1), F.floor(F.col("event_id") * waves / F.lit(top + 1))) == waves - 1 - wave
        events.where(share).coalesce(1).write.mode("append").parquet(f"{base}/arriving")
    target = Table(spark, f"{base}/table")
    upsert_stream(stream_table(spark, f"{base}/arriving", files_per_trigger=1), target, ["user_id"], "event_id", f"{base}/progress").awaitTermination()
    return target.read().select("user_id", "event_id", "event_type")


def stream_windowed_counts(spark, d):
    """Counts by hour and type with a watermark, kept up to date in a table."""
    from sedimenta.sources.versions import Table
    from sedimenta.streaming.upserts import stream_table, windowed_stream

    base = _scratch(spark, "stream")
    target = Table(spark, f"{base}/table")
    windowed_stream(stream_table(spark, f"{d}/events.parquet"), target, f"{base}/progress").awaitTermination()
    return target.read().select("hour", "event_type", "n", "total")


def staged_csv(spark, d):
    """Rows staged as text files, read back as text and typed with a check."""
    from pyspark.sql.types import StructType

    from sedimenta.sources.versions import read_staged_csv

    path = _scratch(spark, "staged")
    _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    rows = read_staged_csv(spark, path, StructType.fromDDL("n_nationkey INT, n_name STRING, n_regionkey INT"))
    return rows.select(F.col("n_nationkey").try_cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").try_cast("int").alias("n_regionkey"))


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
SINCE = "1997-01-01 00:00:00"


def staged_database(spark, d) -> str:
    """A table of a database with the orders, under the shared folder, which has to be one of local paths.

    Derby lets only one JVM open a database for writing. So the driver's has it import staged files, row by row, and closes
    it; packed into a jar it is read-only, and every executor opens it.
    """
    import os
    import zipfile

    jvm, base = spark._jvm, _scratch(spark, "database")
    at = jvm.org.apache.hadoop.fs.Path(base)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        raise RuntimeError("the staged database needs a spark.checkpoint.dir of local paths")
    base = fs.makeQualified(at).toUri().getPath()
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderstatus", 1, 1).alias("o_orderstatus"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    # JDBC reads a database's timestamps in the zone of the JVM
    o.write.option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("timeZone", jvm.java.util.TimeZone.getDefault().getID()).csv(f"{base}/rows")
    driver, none = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), jvm.java.util.Properties()
    connection = driver.connect(f"jdbc:derby:{base}/db;create=true", none)
    run = connection.createStatement()
    run.execute('CREATE TABLE orders ("o_orderkey" BIGINT, "o_custkey" BIGINT, "o_orderstatus" VARCHAR(1), "updated_at" TIMESTAMP)')
    for name in sorted(os.listdir(f"{base}/rows")):
        if name.startswith("part-"):
            run.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ORDERS', '{base}/rows/{name}', ',', '\"', 'UTF-8', 0)")
    connection.close()
    try:
        driver.connect(f"jdbc:derby:{base}/db;shutdown=true", none)
    except Exception as e:  # noqa: BLE001  that is how Derby tells that it has closed a database
        if "shutdown" not in str(e):
            raise
    with zipfile.ZipFile(f"{base}/db.jar", "w", zipfile.ZIP_STORED) as jar:
        for folder, _, names in os.walk(f"{base}/db"):
            for name in names:
                jar.write(f"{folder}/{name}", os.path.relpath(f"{folder}/{name}", base))
    return f"jdbc:derby:jar:({base}/db.jar)db"


def jdbc_extraction(spark, d):
    """What a database has from a watermark on, read in ranges of keys."""
    from sedimenta.sources.versions import read_jdbc

    import datetime as dt

    rows = read_jdbc(spark, staged_database(spark, d), "orders", "o_orderkey", "updated_at", dt.datetime.fromisoformat(SINCE), parts=4, properties=DERBY)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("updated_at").alias("day"))


def overlapping_orders(spark, d):
    """Pairs of a customer's orders that lie within a week of each other, by bins of a week."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", _day("o_orderdate").alias("a")).withColumn("z", F.date_add("a", 7))
    pairs = joins.overlapping_pairs(o, "o_custkey", "o_orderkey", "a", "z", 7)
    return pairs.select(F.col("left_id").alias("left_key"), F.col("right_id").alias("right_key"))


def fingerprint_tree(spark, d):
    """The line items' tree of digests: 256 orders a leaf, 64 children a node. A null stands for some of the flags."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    columns = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), flag, _day("l_shipdate")]
    return fingerprints.tree(_t(spark, d, "lineitem"), "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey"], columns)


def _tree_sql() -> str:
    values = ("l_orderkey", "l_linenumber", "l_partkey", "nullif(l_returnflag, 'N')", "CAST(l_shipdate AS DATE)")
    row = "md5(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE length(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for v in values) + ")"
    leaves = f"l0 AS (SELECT l_orderkey // 256 AS node, md5(string_agg({row}, '' ORDER BY l_orderkey, l_linenumber, l_partkey, {row})) AS digest FROM lineitem GROUP BY 1)"
    above = ", ".join(f"l{i} AS (SELECT node // 64 AS node, md5(string_agg(digest, '' ORDER BY node)) AS digest FROM l{i - 1} GROUP BY 1)" for i in range(1, 7))
    # a level is there as long as the one below it has more than one node
    rows = " UNION ALL ".join(["SELECT 0 AS level, node, digest FROM l0", *(f"SELECT {i}, node, digest FROM l{i} WHERE (SELECT min(node) <> max(node) FROM l{i - 1})" for i in range(1, 7))])
    return f"WITH {leaves}, {above} SELECT CAST(level AS INT) AS level, CAST(node AS BIGINT) AS node, digest FROM ({rows}) x"


def delete_range(spark, d):
    """Rows of some customers go where their day lies in a range."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", _day("o_orderdate").alias("day"))
    keys = _t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    low, high = (F.lit(x).cast("date") for x in ("1996-01-01", "1997-12-31"))
    return merges.delete_between(o, keys, "day", low, high).select("o_orderkey")


def update_from(spark, d):
    """Customers take a value from their orders where these have one."""
    latest = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(-1).cast("long").alias("last_order"))
    return merges.update_from(c, latest, ["c_custkey"], ["last_order"], F.col("c_mktsegment") != "BUILDING")


def truncate_reload(spark, d):
    """A table is emptied and filled anew; readers see a whole version at any time."""
    from sedimenta.sources.versions import Table

    t = Table(spark, _scratch(spark, "table"))
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    t.replace(s)
    t.replace(s.limit(0))
    emptied = t.read().count()
    t.replace(s.where("s_nationkey % 2 = 0"))
    return t.read().withColumn("rows_when_empty", F.lit(emptied).cast("long"))


def temp_table(spark, d):
    """A temporary table that two steps of one query read."""
    _t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")).createOrReplaceTempView("finished_orders")
    return spark.sql("SELECT o_custkey, n FROM finished_orders WHERE n > (SELECT avg(n) FROM finished_orders)")


_CATALOG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def catalog_scan(spark, d):
    """Columns that the catalog lists for the engine's tables."""
    from sedimenta.sources.versions import catalog_columns

    for name in _CATALOG:
        _t(spark, d, name).createOrReplaceTempView(name)
    return catalog_columns(spark).where(F.col("table_name").isin(*_CATALOG)).select("table_name", "column_name", F.col("ordinal").cast("long").alias("ordinal"))


def catalog_row_counts(spark, d):
    """What the catalog lists joined with the tables' row counts."""
    wide = catalog_scan(spark, d).groupBy("table_name").agg(F.count("*").alias("n_columns"))
    counts = [_t(spark, d, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n in _CATALOG]
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return wide.join(both, "table_name")


QUERIES = {
    "dq_flags": (dq_flags, D_CLEAN),
    "flag_histogram": (flag_histogram, f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(dq_flags, ',')) AS flag FROM ({D_CLEAN})) GROUP BY flag"),
    "clamp_and_null_rule": (clamp_and_null_rule, "SELECT event_id, CASE WHEN v > 200 THEN NULL ELSE CAST(least(greatest(v, 5), 100) AS DECIMAL(18,4)) END AS clean, nullif(concat_ws(',', CASE WHEN v > 100 AND v <= 200 THEN 'CAPPED' END, CASE WHEN v < 5 THEN 'FLOORED' END, CASE WHEN v > 200 THEN 'INVALID' END), '') AS dq_flags FROM (SELECT event_id, CAST(value AS DECIMAL(18,4)) AS v FROM events)"),
    "null_safe_row_compare": (null_safe_row_compare, f"SELECT c.c_custkey FROM customer c JOIN ({D_CLEAN}) n ON n.c_custkey = c.c_custkey WHERE {D_CENTS.format('c.c_acctbal')} IS DISTINCT FROM n.cents OR c.c_mktsegment IS DISTINCT FROM n.segment OR c.c_nationkey IS DISTINCT FROM n.nation_key"),
    "validation_split": (validation_split, "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderpriority LIKE '4%' THEN 'o_orderpriority is missing' END, CASE WHEN o_totalprice > 400000 THEN 'o_totalprice is out of range' END) AS details FROM orders WHERE o_orderpriority LIKE '4%' OR o_totalprice > 400000"),
    "dq_scorecard": (dq_scorecard, f"SELECT 'customer.negative_balance' AS rule, count(*) AS rows_hit FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'customer.segment_case', count(*) FROM customer WHERE c_mktsegment <> {D_INITCAP.format('c_mktsegment')} UNION ALL SELECT 'orders.no_priority', count(*) FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' UNION ALL SELECT 'orders.status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'lineitem.discount', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.05 UNION ALL SELECT 'lineitem.zero_tax', count(*) FROM lineitem WHERE l_tax = 0 UNION ALL SELECT 'events.duplicates', count(*) - count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) FROM events"),
    "dedupe_keep_first": (dedupe_keep_first, "SELECT event_id, n > 1 AS is_duplicate, CASE WHEN n > 1 THEN f END AS duplicate_of_id FROM (SELECT event_id, row_number() OVER w AS n, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id))"),
    "dedupe_rejects": (dedupe_rejects, "SELECT doc_id, f AS duplicate_of_id, 'DUPLICATE' AS reason FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id > f"),
    "scd2_asof_join": (scd2_asof_join, "WITH v0 AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS b, min(o_orderkey) AS vo, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1, 2), v AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY k ORDER BY b) - 1, DATE '9999-12-31') AS e FROM v0) SELECT o_orderkey, vo AS version_order, coalesce(p, 'Unknown') AS priority FROM orders LEFT JOIN v ON k = o_custkey AND CAST(o_orderdate + INTERVAL 20 DAY AS DATE) BETWEEN b AND e"),
    "inventory_daily_snapshot": (inventory_daily_snapshot, f"WITH {D_SNAP} SELECT item, day, on_loan, overdue FROM snap"),
    "warehouse_utilisation_monthly": (warehouse_utilisation_monthly, f"WITH {D_SNAP} SELECT c_nationkey, CAST(year(day) * 100 + month(day) AS BIGINT) AS month_key, CAST(sum(on_loan) AS BIGINT) AS loan_days, count(*) AS days, count(DISTINCT item) AS items, CAST((20000 * sum(on_loan) + count(*)) // (2 * count(*)) AS BIGINT) AS utilisation_bp FROM snap JOIN customer ON c_custkey = item GROUP BY 1, 2"),
    "insert_ignore": (insert_ignore, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"),
    "upsert_merge": (upsert_merge, "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 <> 1 THEN false END AS is_duplicate, CASE WHEN (o_orderkey % 10 = 0 AND o_orderstatus <> 'X') OR o_orderkey % 4 = 1 THEN 'b2' ELSE 'b1' END AS batch_id FROM orders WHERE o_orderkey % 4 <> 1 OR o_orderkey % 5 = 0"),
    "delete_insert": (delete_insert, "SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN user_id % 7 = 0 THEN count(*) ELSE 0 END AS n FROM events GROUP BY 1, 2"),
    "scd1_merge": (scd1_merge, "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + 1000 ELSE (SELECT max(c_custkey) + 1000 FROM customer WHERE c_custkey % 3 <> 0) + row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey) END AS customer_key, CASE WHEN c_custkey % 3 = 0 THEN 'inserted' WHEN c_custkey % 10 = 1 THEN 'updated' ELSE 'kept' END AS action, CASE WHEN c_custkey % 10 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "scd2_merge": (scd2_merge, """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 = 0 THEN DATE '2024-06-01' ELSE DATE '1900-01-01' END AS f FROM customer)
      SELECT c_custkey, CASE WHEN f > DATE '2024-03-15' THEN seg ELSE c_mktsegment END AS c_mktsegment, upper(c_name) AS c_name, f AS effective_from, CASE WHEN seg <> c_mktsegment AND f < DATE '2024-03-15' THEN DATE '2024-03-14' END AS effective_to, NOT (seg <> c_mktsegment AND f < DATE '2024-03-15') AS is_current FROM c WHERE c_custkey % 4 <> 0
      UNION ALL SELECT c_custkey, seg, upper(c_name), DATE '2024-03-15', NULL, true FROM c WHERE c_custkey % 4 <> 0 AND seg <> c_mktsegment AND f < DATE '2024-03-15'
      UNION ALL SELECT c_custkey, seg, upper(c_name), DATE '1900-01-01', NULL, true FROM c WHERE c_custkey % 4 = 0"""),
    "flow_rejects_json": (flow_rejects_json, "SELECT md5(props) AS h, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, count(*) AS occurrence_count FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "change_set_rebuild": (change_set_rebuild, "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY 1, 2"),
    "stream_windowed_counts": (stream_windowed_counts, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY 1, 2"),
    "staged_csv": (staged_csv, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "jdbc_extraction": (jdbc_extraction, f"SELECT o_orderkey, o_custkey, substr(o_orderstatus, 1, 1) AS o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '{SINCE}'"),
    "overlapping_orders": (overlapping_orders, "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + 7 AS e FROM orders) SELECT a.k AS left_key, b.k AS right_key FROM o a JOIN o b ON a.c = b.c AND a.k < b.k AND a.b < b.e AND b.b < a.e"),
    "fingerprint_tree": (fingerprint_tree, _tree_sql()),
    "delete_range": (delete_range, "SELECT o_orderkey FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')"),
    "update_from": (update_from, "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN coalesce(m, -1) ELSE -1 END AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey"),
    "truncate_reload": (truncate_reload, "SELECT s_suppkey, s_nationkey, CAST(0 AS BIGINT) AS rows_when_empty FROM supplier WHERE s_nationkey % 2 = 0"),
    "temp_table": (temp_table, "WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, n FROM f WHERE n > (SELECT avg(n) FROM f)"),
    "catalog_scan": (catalog_scan, f"SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal FROM information_schema.columns WHERE table_name IN {_CATALOG}"),
    "catalog_row_counts": (catalog_row_counts, f"SELECT table_name, n_columns, n_rows FROM (SELECT table_name, count(*) AS n_columns FROM information_schema.columns WHERE table_name IN {_CATALOG} GROUP BY 1) c JOIN ({' UNION ALL '.join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _CATALOG)}) r USING (table_name)"),
    "stream_upsert_events": (stream_upsert_events, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
