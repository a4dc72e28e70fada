"""Where plans register: name, survey ids, function and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def put(f: Callable) -> Callable:
        name = f.__name__
        assert name not in QUERIES, name
        QUERIES[name], IDS[name] = f, ids
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put
