"""Column functions whose semantics differ from Spark's built-ins."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def initcap_any(c: Column) -> Column:
    """Upper-cases the first letter after any character that is not a letter or digit, lower-cases the rest (ASCII)."""
    parts = F.split(F.lower(c), "(?<=[^a-z0-9])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def flags(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that fire, comma-joined in order; null if none does. A null condition does not fire."""
    return F.nullif(F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules]), F.lit(""))


def full_years(start: Column, end: Column) -> Column:
    """Completed years between two dates: a birthday that is not reached yet does not count."""
    early = (F.month(end) * 100 + F.day(end)) < (F.month(start) * 100 + F.day(start))
    return F.year(end) - F.year(start) - early.cast("int")


def text_to_bigint(c: Column) -> Column:
    """Integers staged as text such as `1.0`."""
    return F.try_cast(c, "decimal(20,4)").cast("bigint") if hasattr(F, "try_cast") else c.try_cast("decimal(20,4)").cast("bigint")
