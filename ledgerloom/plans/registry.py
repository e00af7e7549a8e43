"""Registry of the named queries: each with its Spark plan and, where SQL can tell it, a DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under a name; `covers` lists the inventory's ids."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(plan, tuple(covers.split()), sql and sql.strip())
        return plan

    return register
