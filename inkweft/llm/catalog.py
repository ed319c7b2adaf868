"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from inkweft.llm import q_leakage, q_mixing, q_neardup, q_normal, q_pages, q_repetition, q_splitting, q_terms

MODULES = [q_terms, q_neardup, q_normal, q_pages, q_splitting, q_leakage, q_mixing, q_repetition]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
