"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

from gradus.plans.registry import QUERIES, SQL

MODULES = (
    "tables", "columns", "lookups", "statistics", "rankings", "features", "selections", "evaluations", "clusters", "learning", "checks",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"gradus.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)
