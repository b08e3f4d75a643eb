"""Registry of queries: a Spark builder, the matching SQL and the survey items covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the decorated builder under its own name."""
    def add(build):
        QUERIES[build.__name__] = Query(build.__name__, build, tuple(covers.split()), sql)
        return build
    return add
