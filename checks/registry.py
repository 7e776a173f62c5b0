from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def checked(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL it must agree with."""

    def register(query: Query) -> Query:
        name = query.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        ORACLES[name] = sql
        return query

    return register
