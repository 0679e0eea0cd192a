"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame, with its DuckDB equivalent where SQL can express it."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put
