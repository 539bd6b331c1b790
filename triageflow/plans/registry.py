"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str  # SURVEY operator ids


QUERIES: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, covers)
        return fn
    return deco
