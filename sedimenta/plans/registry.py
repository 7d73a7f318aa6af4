"""Every registered query of the engine and its DuckDB text."""

from __future__ import annotations

from sedimenta.plans import layers, relational, warehouse


def queries() -> dict:
    return relational.queries() | warehouse.queries() | layers.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | warehouse.oracle_sql() | layers.oracle_sql()
