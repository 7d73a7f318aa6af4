"""Keyed table mutations as plans: each takes the current table and a batch, and gives the new table.

No plan overwrites what it reads; writing the result to a new version and switching to it is sources.versions' job.
All joins are on the keys only, so a table bucketed or partitioned by its key merges without moving.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Where the first version of a type-2 member begins.
FIRST_DATE = "1900-01-01"
#: Ranges in which new members are numbered side by side.
RANGES = 64
#: Keys of the sample that the ranges are cut by.
SAMPLE = 4096


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def insert_ignore(current: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key is new are added, one for each key; replaying a batch adds nothing."""
    new = one_of_each(batch, key).join(current.select(key), key, "left_anti")
    return current.unionByName(new.select(current.columns))


def one_of_each(batch: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, of several the least by its values: an order that no layout of the input changes. Rows are
    reduced before they are shuffled."""
    rest = [c for c in batch.columns if c not in key]
    if not rest:
        return batch.distinct()
    return batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(batch.columns)


def upsert(current: DataFrame, batch: DataFrame, key: list[str], stamps: list[str] = ()) -> DataFrame:
    """Batch rows replace those of their key. Columns that the batch lacks keep their value, and a row that only
    differs in `stamps` keeps all of its old values, so that an identical delivery changes nothing. Of several batch
    rows of a key one counts (one_of_each), so that no key multiplies."""
    batch = one_of_each(batch, key)
    compared = [c for c in batch.columns if c not in key and c not in stamps]
    both = current.withColumn("_old", F.lit(True)).alias("o").join(batch.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    unchanged = F.col("o._old") & F.col("n._new") & (_same("o", "n", compared) if compared else F.lit(True))
    take = F.col("n._new") & ~F.coalesce(unchanged, F.lit(False))
    out = [F.col(k) for k in key]
    for c in current.columns:
        if c not in key:
            out.append((F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in batch.columns else F.col(f"o.{c}")).alias(c))
    return both.select(out).select(current.columns)


def delete_insert(current: DataFrame, rebuilt: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in `keys` are replaced by `rebuilt`; keys may hold several columns."""
    return current.join(keys.distinct(), keys.columns, "left_anti").unionByName(rebuilt.select(current.columns))


def delete_between(current: DataFrame, keys: DataFrame, column: str, low, high) -> DataFrame:
    """current without the rows whose key is in `keys` and whose `column` lies from low to high."""
    names = keys.columns
    gone = keys.distinct().select(*[F.col(k).alias(f"_g_{k}") for k in names])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_g_{k}") for k in names])
    return current.join(gone, same & F.col(column).between(F.lit(low), F.lit(high)), "left_anti")


def update_from(current: DataFrame, other: DataFrame, key: list[str], columns: list[str], when: Column | None = None) -> DataFrame:
    """Columns of current rows take the values that the row of their key in `other` has, where it has one (and `when` holds)."""
    new = one_of_each(other.select(*key, *columns), key).select(*key, *[F.col(c).alias(f"_u_{c}") for c in columns], F.lit(True).alias("_u"))
    hit = F.col("_u").isNotNull() if when is None else F.col("_u").isNotNull() & F.coalesce(when, F.lit(False))
    j = current.join(new, key, "left")
    return j.select(*[F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def scd1(current: DataFrame, incoming: DataFrame, key: str, surrogate: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Type-1 dimension with `action`: inserted, updated or kept. New members get the next surrogate keys in key order."""
    attributes = [c for c in incoming.columns if c != key]
    both = current.alias("o").join(incoming.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    action = F.when(F.col(f"o.{surrogate}").isNull(), "inserted").when(F.coalesce(F.col("_new"), F.lit(False)) & ~_same("o", "n", attributes), "updated").otherwise("kept")
    merged = both.select(F.col(key), F.col(f"o.{surrogate}").alias(surrogate), action.alias("action"), *[F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in attributes])
    return with_surrogates(merged, current, key, surrogate, keep)


def with_surrogates(rows: DataFrame, current: DataFrame, key: str | list[str], surrogate: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Numbers the rows without a surrogate upwards from the greatest, in key order. Only new members are ranked.

    The first key column, of any type that has an order, is cut into ranges at quantiles of a bounded sample; each range is
    ranked on its own and starts where the ones before it end. The sample decides how even the ranges are and nothing else.
    Only it and a count for each range are gathered. `keep` writes rows and gives them as they were written; without it they
    are made anew for the sample, the counts and the result.
    """
    rows = rows if keep is None else keep(rows)
    keys = [key] if isinstance(key, str) else key
    top = current.agg(F.coalesce(F.max(surrogate), F.lit(0)).cast("long")).first()[0]
    new = rows.where(F.col(surrogate).isNull())
    found = new.select(keys[0]).where(F.col(keys[0]).isNotNull()).orderBy(F.xxhash64(keys[0])).limit(SAMPLE).collect()
    sample = sorted(r[0] for r in found)
    cuts = sorted({sample[i * len(sample) // RANGES] for i in range(1, RANGES)}) if sample else []
    kind = rows.schema[keys[0]].dataType
    place = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c < F.col(keys[0]))) if cuts else F.lit(0)
    new = new.withColumn("_range", place)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    starts = new.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = new.join(F.broadcast(starts), "_range").withColumn(surrogate, (F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) + F.col("_start") + F.lit(top)).cast("long"))
    return rows.where(F.col(surrogate).isNotNull()).unionByName(ranked.select(rows.columns))


def scd2(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], type1: list[str], change_date: str, first_date: str = FIRST_DATE) -> DataFrame:
    """Type-2 dimension (effective_from, effective_to, is_current) after a batch of one row for each key.

    In this order: type-1 columns are overwritten in every version; a tracked change dated no later than the current
    version's start overwrites it in place; a later one closes it the day before and opens a new version; an unknown key
    opens its first version at first_date.
    """
    columns = [key, *tracked, *type1, "effective_from", "effective_to", "is_current"]
    n = incoming.select(key, *[F.col(c).alias(f"n_{c}") for c in (*tracked, *type1)], F.col(change_date).alias("n_date"), F.lit(True).alias("n_row"))
    j = current.join(n, key, "left")
    for c in type1:
        j = j.withColumn(c, F.when(F.col("n_row"), F.col(f"n_{c}")).otherwise(F.col(c)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in tracked])
    changed = F.col("is_current") & F.coalesce(F.col("n_row"), F.lit(False)) & ~same
    in_place, closes = changed & (F.col("n_date") <= F.col("effective_from")), changed & (F.col("n_date") > F.col("effective_from"))
    j = j.withColumns({"_in": in_place, "_cl": closes})
    old = j.select(key, *[F.when(F.col("_in"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in tracked], *type1, "effective_from", F.when(F.col("_cl"), F.date_sub("n_date", 1)).otherwise(F.col("effective_to")).alias("effective_to"), (F.col("is_current") & ~F.coalesce(F.col("_cl"), F.lit(False))).alias("is_current"))
    open_to = F.lit(None).cast("date").alias("effective_to")
    later = j.where("_cl").select(key, *[F.col(f"n_{c}").alias(c) for c in (*tracked, *type1)], F.col("n_date").alias("effective_from"), open_to, F.lit(True).alias("is_current"))
    first = incoming.join(current.select(key).distinct(), key, "left_anti").select(key, *tracked, *type1, F.lit(first_date).cast("date").alias("effective_from"), open_to, F.lit(True).alias("is_current"))
    return old.select(columns).unionByName(later.select(columns)).unionByName(first.select(columns))
