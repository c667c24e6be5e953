"""Queries of the offer and planning operators by name, and DuckDB SQL for the same rows."""

from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
