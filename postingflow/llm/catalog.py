"""The registered queries of this package, each beside its SQL where SQL can say it."""

from __future__ import annotations

from postingflow.llm import balltree, contamination, language, merkle, mixing, packing, quality, repair, sharding, simhash, suffixes, toxicity, urls

MODULES = [language, simhash, suffixes, sharding, balltree, mixing, packing, quality, toxicity, urls, repair, merkle, contamination]


def all_queries() -> dict:
    """Query name to (spark, folder) -> DataFrame."""
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    """Query name to the equivalent SQL."""
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
