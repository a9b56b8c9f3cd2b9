"""Registered queries: each runs operators over the whole given tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from postingflow.plans.catalog import extraction, matching, serving, text

MODULES = [text, extraction, matching, serving]


def all_queries() -> dict:
    """Query name to (spark, folder) -> DataFrame."""
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    """Query name to the equivalent SQL, for the queries that have one."""
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
