"""Named queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` it is compared by brute force in tests."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def fragment(name: str, *needs: str, sql: str) -> None:
    """Declare a common table expression that other SQL may build on."""
    _FRAGMENTS[name] = (needs, sql)


def using(*names: str, select: str) -> str:
    """``WITH`` the named expressions, and those they need, then ``select``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in _FRAGMENTS[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({_FRAGMENTS[n][1]})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + select
