"""All queries of the core, and their SQL."""

from __future__ import annotations

from chronoweave.plans import core_queries, general_queries, graph_queries, table_queries

MODULES = [core_queries, graph_queries, general_queries, table_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
