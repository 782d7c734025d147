"""Where the named queries and their SQL twins are collected."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxlake.plans.fixtures import FX_SQL, Fixtures

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame`` under ``name`` with the SQL that gives the same rows."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_fixtures(sql)
        return fn

    return wrap


def _needed(text: str, found: list[str]) -> None:
    for name in re.findall(r"\bfx_\w+", text):
        if name not in found:
            _needed(FX_SQL[name], found)
            if name not in found:
                found.append(name)


def with_fixtures(sql: str) -> str:
    """Put the fixture views a statement mentions in front of it as CTEs."""
    names: list[str] = []
    _needed(sql, names)
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    rest = body[own.end():] if own else body
    ctes = ",\n".join(f"{n} AS (\n{FX_SQL[n].strip()}\n)" for n in names)
    if not ctes:
        return body
    return f"WITH RECURSIVE {ctes}{',' if own else ''}\n{rest}"


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from voxlake.plans import load_all

    load_all()
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def _bind(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Fixtures(spark, sf_dir))

    return run


def all_sql() -> dict[str, str]:
    from voxlake.plans import load_all

    load_all()
    return dict(_SQL)
