"""Registered queries of the clause engine with their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "version_queries", "scoring_queries", "retrieval_queries", "linking_queries", "entry_queries", "label_queries", "flow_queries", "sheet_queries", "relational_queries")


def _all() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f".plans.{name}", __package__).QUERIES
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
