"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from complyframe.plans.views import with_views
from complyframe.sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, str] = {}
_FEW: set[str] = set()


def query(name: str, sql: str | None = None, few_substances: bool = False):
    """Register ``fn(tables) -> DataFrame``; views named in ``sql`` are spelled out in front of it.

    With ``few_substances`` both sides see 20 substances whatever the number of products.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder, few_substances=few_substances))
        if sql is not None:
            _TWINS[name] = sql
        if few_substances:
            _FEW.add(name)
        return fn

    return register


def oracles() -> dict[str, str]:
    """SQL per query, complete with the views it names."""
    return {name: with_views(sql, name in _FEW) for name, sql in _TWINS.items()}
