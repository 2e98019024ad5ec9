"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _signature(df: DataFrame) -> tuple:
    return tuple(
        df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that is not the root of its component.

    The root is the smallest node. Each round links every node to the smallest of its neighbours
    (large star: from the nodes above it; small star: from those below), by a minimum that is
    aggregated before the shuffle; no list of neighbours is ever gathered. A round is written to the
    shared folder, so the plan stays short and a lost executor costs one round at most. A component
    of any shape is a star after O(log² n) rounds. Null ends and loops are ignored.
    """
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = written(edges, "components")
    seen = _signature(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        smallest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(smallest, "u")
            .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = written(small, "components")
        now = _signature(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components not found in {max_rounds} rounds")
