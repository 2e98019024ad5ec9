"""Operators of a training-data pipeline over text documents, pages and vectors.

Each operator is a module with a general interface; its query is the thin ``opN_`` function in
``queries.py``. Nothing outside this folder imports it.
"""

from __future__ import annotations

import importlib


def load_queries() -> dict:
    """Name to ``(spark, folder) -> DataFrame``."""
    return dict(importlib.import_module(f"{__name__}.queries").QUERIES)


def load_sql() -> dict[str, str]:
    """Checking SQL, where SQL can express the query."""
    return dict(importlib.import_module(f"{__name__}.queries").SQL)
