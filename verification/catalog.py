"""Every registered query with its oracle, grouped as in the operator index of the README."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def once(build: Query) -> Query:
    """Keep a stage's result per session and data folder, as a deployed run keeps its stage tables."""
    kept: dict[tuple[str, str], object] = {}

    @functools.wraps(build)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = build(spark, sf_dir)
        return kept[key]

    return get


def _load() -> None:
    from verification import batch_queries, ledger_queries, model_queries, score_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
