"""Fingerprints of tables that tell order and nulls, as a tree by which two versions are compared piece by piece.

A leaf holds the rows of a range of keys; its digest is that of its rows' digests in order. A node's digest is that of its
children's in order, up to one root. Equal trees mean equal rows in equal order; where roots differ, only the children of
unequal nodes are looked at. Leaves are bounded by the width of their range where keys are (nearly) unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(c: Column) -> Column:
    """A value as text of which no two different rows can be made: its length stands ahead, and null is apart from all text."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    return F.md5(F.concat(*map(marked, columns)))


def tree(rows: DataFrame, key: str, order: list[str], columns: list[Column], leaf: int = 256, fan: int = 64) -> DataFrame:
    """level, node, digest: leaves (level 0) of `leaf` keys, `fan` children for each node above. Rows without a key go to the
    leaf -1. Empty tables have no nodes."""
    number = F.coalesce(F.floor(F.col(key) / leaf), F.lit(-1)).cast("long")
    one = F.struct(*[F.col(c) for c in order], digest(*columns).alias("h"))
    joined = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ""))
    level = rows.select(number.alias("node"), one.alias("r")).groupBy("node").agg(joined("r").alias("digest"))
    out, n = level.select(F.lit(0).alias("level"), "node", "digest"), 0
    low, high = rows.agg(F.min(number), F.max(number)).first()
    while low is not None and low != high:
        n, low, high = n + 1, low // fan, high // fan
        level = level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("node")).agg(joined(F.struct(F.col("node").alias("k"), F.col("digest").alias("h"))).alias("digest"))
        out = out.unionByName(level.select(F.lit(n).alias("level"), "node", "digest"))
    return out


def unequal_leaves(left: DataFrame, right: DataFrame, fan: int = 64) -> list[int]:
    """Leaves that differ between two trees (or that one lacks), found from the root down: only children of unequal nodes are read.
    As many nodes as differ come to the driver at each level."""
    top = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    level = min((x for x in top if x is not None), default=None)
    if level is None:
        whole = left if top[0] is not None else right
        return [] if top == [None, None] else sorted(r[0] for r in whole.where("level = 0").select("node").collect())
    parents: list[int] | None = None
    while True:
        a, b = (t.where(F.col("level") == level) for t in (left, right))
        if parents is not None:
            inside = F.floor(F.col("node") / fan).isin(parents)
            a, b = a.where(inside), b.where(inside)
        j = a.select("node", F.col("digest").alias("x")).join(b.select("node", F.col("digest").alias("y")), "node", "full_outer")
        parents = sorted(r[0] for r in j.where(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect())
        if not parents or level == 0:
            return parents
        level -= 1
