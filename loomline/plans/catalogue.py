"""Registry of the named queries and of the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame, with its oracle where SQL can say it."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for name in ("q_text", "q_chunks", "q_sets", "q_joins", "q_windows", "q_flows"):
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
