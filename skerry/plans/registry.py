"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from skerry.plans import indexing, search

QUERIES = search.QUERIES | indexing.QUERIES
SQL: dict[str, str] = search.SQL | indexing.SQL
