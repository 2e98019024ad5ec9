"""Queries over the fact tables: role views, the query registry and the checking SQL."""

from .registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
