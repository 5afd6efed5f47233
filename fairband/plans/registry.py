"""Registry of named queries: ``QUERIES[name](spark, sf_dir)`` and ``ORACLE[name]`` (DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query builder and (optionally) its DuckDB oracle."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from fairband.plans import (q_core, q_filters, q_aggregates,  # noqa: F401
                                q_features, q_models, q_neighbors, q_io, q_streaming, q_invariants, q_rows)
