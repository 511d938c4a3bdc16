"""Every query of the support-desk engine by name, each beside its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "analytics_daily"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a callable of (spark, sf_dir) under ``name``."""

    def add(make):
        assert name not in _QUERIES, name
        _QUERIES[name] = make
        if oracle is not None:
            _ORACLE[name] = oracle
        return make

    return add


def _load() -> None:
    from .plans import catalogue  # noqa: F401  registers on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
