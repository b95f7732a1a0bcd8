"""Registered queries, by inventory ID, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name``, with the DuckDB SQL for the same rows if SQL can express them."""

    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    from corpusloom.plans import curation, deep, filters, more, parse, relational, rest, retrieve, search, sets, streams, talk  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
