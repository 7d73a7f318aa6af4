"""Validation split and one-scan scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_valid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with `details`): a rule names what is wrong when its condition is true."""
    checked = df.withColumn("details", F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return checked.where("details = ''").drop("details"), checked.where("details <> ''")


def scorecard(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rule, rows_hit: every rule of a table is counted in one scan."""
    counts = df.agg(*[F.count_if(c).alias(f"r{i}") for i, (_, c) in enumerate(rules)])
    pairs = ", ".join(f"'{n}', r{i}" for i, (n, _) in enumerate(rules))
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, rows_hit)"))
