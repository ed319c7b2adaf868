"""All queries of the core with their SQL."""

from __future__ import annotations

from inkweft.plans import base_queries, conversion, references, retrieval

MODULES = [retrieval, base_queries, conversion, references]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
