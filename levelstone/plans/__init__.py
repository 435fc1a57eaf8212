"""Registered queries of the time-series engine and SQL that says the same."""

from .registry import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
