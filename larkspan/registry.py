"""Registry of the queries over the sample tables and of their DuckDB twins.

Query modules under `larkspan.queries` call `query(name, sql)`; importing this
module imports them all.
"""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator that registers fn(spark, sf_dir) under `name`, with its oracle SQL."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return put


for _m in ("relational", "analysis", "scalars", "rich", "front", "more"):
    import_module(f"larkspan.queries.{_m}")
