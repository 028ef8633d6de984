"""Name -> (query callable, DuckDB oracle SQL). Plan modules register here."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

PLAN_MODULES = (
    "tessera.plans.basket_q",
    "tessera.plans.community_q",
    "tessera.plans.graph_q",
    "tessera.plans.relational_q",
    "tessera.plans.aggregate_q",
    "tessera.plans.window_q",
    "tessera.plans.functions_q",
    "tessera.plans.ml_q",
    "tessera.plans.sources_q",
    "tessera.plans.streaming_q",
    "tessera.plans.udf_q",
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    for mod in PLAN_MODULES:
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as exc:
            if exc.name != mod:
                raise


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(SQL)
