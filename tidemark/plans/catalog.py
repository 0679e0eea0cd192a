"""All of the library's queries and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.plans import q_inventory, q_maintain, q_more, q_pit, q_quality, q_sources, q_text  # noqa: F401  they fill the registry
from tidemark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
