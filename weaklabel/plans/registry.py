"""Registered checks: one Spark query per operator, each paired (where SQL
can say it) with a DuckDB query over the same tables. Every query reads
whole driver tables; column names agree between the two sides."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def query(spark, sf_dir):
            from ..session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        query.__name__, query.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import checks_text, checks_terms  # noqa: F401  (registers on import)
    for mod in ("checks_vectors", "checks_eval", "checks_ml"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if mod not in str(e):
                raise
