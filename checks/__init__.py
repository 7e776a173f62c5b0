"""Queries over the given tables, each with SQL that says what must come out."""

from checks import aggregates, joins, quality, rows, runs, scans  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
