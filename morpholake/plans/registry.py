"""Queries by name, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import SQL_OF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Registers a query; tables are the domain tables that its SQL names, put before it as common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            with_ = ", ".join(f"{t} AS ({SQL_OF[t]})" for t in tables)
            SQL[f.__name__] = (f"WITH {with_}{' ' * (sql[0] != ',')}" if with_ else "") + sql
        return f

    return add
