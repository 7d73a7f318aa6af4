"""As-of joins, dense date expansion and null-aware membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apart(df: DataFrame) -> DataFrame:
    """df for a join in which both sides are shuffled. Without this Spark guesses a side's size from its files, or takes that
    of its compressed shuffle: for a few columns of sorted keys both are so low that millions of rows would be gathered in
    the driver and sent to every task."""
    return df.hint("merge")


def versions_asof(events: DataFrame, versions: DataFrame, key: str, date: str, how: str = "left") -> DataFrame:
    """Joins each event to the version valid on its date: an equi join on the key with the range as residual."""
    v = versions.withColumnRenamed(key, "_k")
    on = (F.col(key) == F.col("_k")) & F.col(date).between(F.col("effective_from"), F.coalesce("effective_to", F.lit("9999-12-31").cast("date")))
    return events.join(v, on, how).drop("_k")


#: Rows of a key from which asof_merge() cuts the key into spans of so many days.
HOT_ROWS, HOT_DAYS = 100_000, 31


def asof_merge(events: DataFrame, versions: DataFrame, key: str, date: str, hot_rows: int = HOT_ROWS, hot_days: int = HOT_DAYS) -> DataFrame:
    """As versions_asof(), for versions of a key that do not overlap, in one pass: events and versions stand together in the
    order of their days, and each event takes the last version that began, if that has not ended. Nothing is multiplied, so a
    key of many events and versions costs their sum and a sort.

    A key with more than hot_rows events is cut into spans of hot_days days, each a group of its own; a version stands in every
    span of the key's events that it reaches into. There are fewer such keys than events / hot_rows, whose first and last days
    alone are broadcast. Events without a key or a day have no version.
    """
    own = [c for c in versions.columns if c != key]
    kind = versions.select(F.struct(*own).alias("_v")).schema["_v"].dataType
    at = F.col(date).cast("date")
    counted = events.where(F.col(key).isNotNull() & at.isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(at).alias("_a"), F.max(at).alias("_z"))
    hot = F.broadcast(counted.where(F.col("_n") > hot_rows).select(F.col(key).alias("_h"), "_a", "_z"))
    span = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / hot_days)
    e = events.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in events.columns])).join(hot, F.col(key) == F.col("_h"), "left")
    e = e.select(F.col(key).alias("_k"), F.when(F.col("_h").isNotNull(), span(at)).alias("_s"), at.alias("_d"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_v"), "_row")
    row_kind = e.schema["_row"].dataType
    v = versions.join(hot, F.col(key) == F.col("_h"), "left")
    first, last = span(F.greatest("effective_from", "_a")), span(F.least(F.coalesce("effective_to", "_z"), F.col("_z")))
    spans = F.when(F.col("_h").isNull(), F.array(F.lit(None).cast("long"))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    v = v.select(F.col(key).alias("_k"), F.explode(spans).alias("_s"), F.col("effective_from").alias("_d"), F.lit(0).alias("_o"), F.struct(*own).alias("_v"), F.lit(None).cast(row_kind).alias("_row"))
    w = Window.partitionBy("_k", "_s").orderBy("_d", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = v.unionByName(e).withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where("_o = 1")
    fits = F.col("_k").isNotNull() & F.col("_d").isNotNull() & (F.coalesce("_m.effective_to", F.lit("9999-12-31").cast("date")) >= F.col("_d"))
    return met.select(*[F.col(f"_row.`{c}`").alias(c) for c in events.columns], *[F.when(fits, F.col(f"_m.`{c}`")).alias(c) for c in own])


def asof_listed(events: DataFrame, versions: DataFrame, key: str, date: str) -> DataFrame:
    """As asof_merge(), for keys with few versions: a key's versions come to its events as one list, so that events which
    already lie by key are neither moved nor sorted. `versions` has effective_from before the columns that are asked for."""
    own = [c for c in versions.columns if c != key]
    listed = versions.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("effective_from", *[c for c in own if c != "effective_from"])).alias("_v"))
    at = F.col(date).cast("date")
    j = events.join(listed.hint("shuffle_hash"), F.col(key) == F.col("_k"), "left")
    j = j.withColumn("_v", F.array_max(F.filter("_v", lambda v: v["effective_from"] <= at)))
    fits = F.coalesce("_v.effective_to", F.lit("9999-12-31").cast("date")) >= at
    return j.select(*[F.col(f"`{c}`") for c in events.columns], *[F.when(fits, F.col(f"_v.`{c}`")).alias(c) for c in own])


def overlapping_pairs(rows: DataFrame, key: str, row_id: str, start: str, end: str, days: int) -> DataFrame:
    """left_id < right_id of rows of one key whose spans [start, end) of days meet, each pair once.

    A span stands in each bin of `days` days that it reaches into, and rows meet in a bin only, so a key of many rows costs
    their number and the pairs that there are (with `days` near the usual length of a span). A pair counts in the first bin
    that both are in. Rows without a key, a start or an end meet nothing; an empty span meets those that
    begin before it and end after it.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bins = F.sequence(F.floor(number(F.col(start)) / days), F.floor(number(F.greatest(F.date_sub(end, 1), start)) / days))
    spread = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, F.col(row_id).alias("i"), F.col(start).alias("a"), F.col(end).alias("z"), F.explode(bins).alias("bin"))
    left, right = spread.alias("l"), spread.alias("r")
    met = left.join(right, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.bin") == F.col("r.bin")) & (F.col("l.i") < F.col("r.i")) & (F.col("l.a") < F.col("r.z")) & (F.col("r.a") < F.col("l.z")))
    once = F.col("l.bin") == F.floor(number(F.greatest("l.a", "r.a")) / days)
    return met.where(once).select(F.col("l.i").alias("left_id"), F.col("r.i").alias("right_id"))


def days_between(start: Column, end: Column) -> Column:
    """Every date from start to end; no element if start is later, where sequence() alone would fail or count backwards."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total for the result to be."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


#: Rows of two or three numbers, and of whole keys, that are gathered in the driver at most.
FEW, FEW_KEYS = 250_000, 10_000


def few(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows of a few numbers, as a side of a join: sent to every task where that is bounded, shuffled where not."""
    return F.broadcast(df) if n <= FEW else apart(df)


def repeated(df: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys that stand on several rows, where they are FEW_KEYS at most; None: they are more. Only keys are shuffled."""
    keys = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    found = keys.limit(FEW_KEYS + 1).collect()
    return None if len(found) > FEW_KEYS else df.sparkSession.createDataFrame(found, keys.schema)


def first_of_repeated(df: DataFrame, twice: DataFrame | None, on: list[str], key: list[str], order: list[Column]) -> DataFrame:
    """As first_of(), where only rows whose `on` is in `twice` can share a key (repeated()): the others are not moved."""
    if twice is None:
        return first_of(df, key, order)
    if twice.isEmpty():
        return df
    some = F.broadcast(twice)
    return df.join(some, on, "left_anti").select(df.columns).unionByName(first_of(df.join(some, on, "left_semi").select(df.columns), key, order))


def ranked_duplicates(df: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """Adds is_duplicate and duplicate_of_id: the lowest id of each key stays. Null keys are equal, as in a window."""
    w = Window.partitionBy(*key).orderBy(row_id)
    n = F.row_number().over(w)
    return df.withColumns({"is_duplicate": n > 1, "duplicate_of_id": F.when(n > 1, F.first(row_id).over(w))})


def allocate(pool: Column, part: Column, total: Column) -> Column:
    """A pool's share by part of total in whole units, rounded half up; null without a total."""
    return F.when(total > 0, F.floor((2 * pool * part + total) / (2 * total)))
