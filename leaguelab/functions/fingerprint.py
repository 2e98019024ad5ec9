"""Deterministic fingerprints of column lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*cols: str | Column) -> Column:
    """SHA-256 of a JSON array of the values, in the order given.

    NULL is written as ``null`` (not dropped), so the same column list always gives the same text.
    """
    items = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(
        F.to_json(F.array(*[x.cast("string") for x in items]), {"ignoreNullFields": "false"}), 256
    )
