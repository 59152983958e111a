"""Registry of named queries: a Spark builder and, where SQL can express it,
a DuckDB twin used as the correctness oracle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    oracle: str | None
    operators: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(name, fn, oracle, operators)
        return fn
    return deco
