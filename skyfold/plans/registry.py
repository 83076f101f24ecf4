"""Registry of queries and the SQL each one is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEW_SQL: dict[str, str] = {}

_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def with_views(body: str) -> str:
    """Prefix ``body`` with a WITH list for every ``v_`` view it needs."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(_NAME.findall(sql)):
            if name in VIEW_SQL and name not in order:
                visit(VIEW_SQL[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in order)
    head = body.lstrip()
    if head.lower().startswith("with "):
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{head}"


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its comparison text."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register
