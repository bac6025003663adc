"""Registered queries (Spark) and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the test
tables; the oracle computes the same result in SQL. Derived doubles are
rounded to 6 digits on both sides; integer widths are aligned by casts.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from airseries.plans import (q_features, q_functions, q_reports,  # noqa: F401
                                 q_registry, q_sources, q_models)
