"""All named queries of the engine."""

from __future__ import annotations

from ledgerloom.plans import queries_episodes, queries_memory, queries_rules, queries_stores, queries_texts, queries_views  # noqa: F401  they register their queries
from ledgerloom.plans.registry import QUERIES, Plan


def queries() -> dict[str, Plan]:
    return {name: q.plan for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
