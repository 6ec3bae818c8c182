"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(Views(spark, sf_dir))
    if sql:
        ORACLES[name] = with_views(sql)
