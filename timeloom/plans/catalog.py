"""Queries over the driver's tables, each with the SQL that says the same in another engine.

A query is registered by ``@query(name, sql)``. Tables stand in for segments, chunks, candidates and the like; FIXTURES.md says which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep
