"""Queries of the engine and the SQL that says the same."""

from __future__ import annotations

from .plans import indexing, parallel

QUERIES = indexing.QUERIES | parallel.QUERIES
ORACLE: dict[str, str] = indexing.ORACLE | parallel.ORACLE
