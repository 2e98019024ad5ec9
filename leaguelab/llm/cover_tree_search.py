"""Exact top-k by integer inner product, with cover trees over queries and data.

Vectors are quantised to integers, so scores are exact and ties are real. Rows and queries are dealt
to the nearest of a bounded number of centres (the top level of the index, farthest points of a
bounded sample) and, within a centre, to shards and groups of bounded size. Every shard holds a
cover tree; a group of queries holds one too. A search walks pairs of nodes, one of each tree: the
inner products below a pair are at most

    <q, p> + |q| R(p) + |p| R(q) + R(q) R(p)

for the points q, p and covering radii R of the two nodes, and a pair is dropped when that is below
the worst k-th score of the queries under q.

Two rounds: every query first searches one shard of its own centre, which gives it a k-th score;
then each group searches all shards of all centres whose bound reaches its worst k-th score. Queries
of one centre (of some, if they have few) form blocks of bounded size, and the pairs of block and shard are the bounds' result: a
shard's vectors go to the blocks that ask for it and to no others. The top level itself only saves
work: no row is ever left out, and recall is 1.

Defined cases: null vectors and vectors with null or non-finite components take no part, nor do
vectors whose length is not the most common one of the data (the smaller of equally common ones); if
norms allow inner products of 2**53 or more, which doubles do not hold exactly, the search raises
ValueError before it starts; a query never finds rows of its own id; ties go to smaller ids; fewer than k other rows give fewer results; rows
of repeated ids are candidates each, and a repeated query id is one query, the one of its smallest
vector; null ids are neither queries nor candidates; an empty table gives an empty result; other
columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

# Norms and bounds are floating point; this slack keeps them on the safe side.
_SLACK = 1e-6
MAX_PRODUCT = 2.0**53  # doubles hold whole numbers below this


@dataclass
class CoverTree:
    """Points in tree order; a node covers ``points[start:stop]`` within ``radius`` of ``center``."""

    points: np.ndarray
    ids: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    children: list[list[int]]


def build_cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = 128) -> CoverTree:
    """By levels: each level's centres are apart by the level's distance, which halves downwards,
    and a point belongs to the nearest centre of its parent."""
    order = np.arange(len(points))
    centers, radii, starts, stops, children = [], [], [], [], []
    exact = points.astype(np.float64)

    def add(start: int, stop: int, center: np.ndarray, parent: int | None) -> tuple[int, np.ndarray]:
        distance = np.sqrt(((exact[order[start:stop]] - center) ** 2).sum(1))
        node = len(centers)
        centers.append(center)
        radii.append(float(distance.max(initial=0.0)) * (1 + _SLACK))
        starts.append(start)
        stops.append(stop)
        children.append([])
        if parent is not None:
            children[parent].append(node)
        return node, distance

    waiting = [(0, len(points), exact[0], None)] if len(points) else []
    while waiting:
        start, stop, center, parent = waiting.pop()
        node, nearest = add(start, stop, center, parent)
        if stop - start <= leaf or radii[node] == 0.0:
            continue
        members = order[start:stop]
        # Centres of the next level: the farthest point again and again, until all are within
        # half the radius or there are enough of them.
        owner = np.zeros(len(members), dtype=np.int64)
        chosen = [center]
        while len(chosen) < 16 and nearest.max() > radii[node] / 2:
            far = int(nearest.argmax())
            chosen.append(exact[members[far]])
            distance = np.sqrt(((exact[members] - chosen[-1]) ** 2).sum(1))
            closer = distance < nearest
            owner[closer] = len(chosen) - 1
            nearest = np.minimum(nearest, distance)
        by = np.argsort(owner, kind="stable")
        order[start:stop] = members[by]
        sizes = np.bincount(owner, minlength=len(chosen))
        ends = start + np.cumsum(sizes)
        for c, size, end in zip(chosen, sizes, ends):
            if size:
                waiting.append((int(end - size), int(end), c, node))
    return CoverTree(
        points[order], ids[order], np.array(centers).reshape(-1, points.shape[1]), np.array(radii),
        np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64), children,
    )


class Best:
    """The k best (score, id) of each query of a tree: high scores, then small ids."""

    def __init__(self, queries: CoverTree, k: int, kth: np.ndarray):
        n = len(queries.ids)
        self.k, self.own = k, queries.ids
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        # Known from before: a score that k candidates reach.
        self.floor = kth

    def worst(self, start: int, stop: int) -> float:
        return float(np.maximum(self.score[start:stop, -1], self.floor[start:stop]).min())

    def offer(self, start: int, stop: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.own[start:stop, None], np.iinfo(np.int64).min, scores)
        width = scores.shape[1]
        if width > 4 * self.k:
            # Everything from the k-th score on, so no tie is lost.
            bar = np.partition(scores, width - self.k, axis=1)[:, width - self.k]
            bar = np.maximum(np.maximum(bar, self.score[start:stop, -1]), self.floor[start:stop])
            some = np.flatnonzero((scores >= bar[:, None]).any(axis=0))
            scores, ids = scores[:, some], ids[some]
        all_scores = np.concatenate([self.score[start:stop], scores], axis=1)
        all_ids = np.concatenate(
            [self.id[start:stop], np.broadcast_to(ids, (stop - start, len(ids)))], axis=1
        )
        all_ids = np.where(all_scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, all_ids)
        by = np.lexsort((all_ids, -all_scores.astype(np.float64), np.zeros_like(all_ids)), axis=1)
        by = by[:, : self.k]
        self.score[start:stop] = np.take_along_axis(all_scores, by, axis=1)
        self.id[start:stop] = np.take_along_axis(all_ids, by, axis=1)


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Walk both trees together; ``best`` is updated in place."""
    if not len(queries.ids) or not len(data.ids):
        return
    q_norm = np.sqrt((queries.center**2).sum(1)) * (1 + _SLACK)
    p_norm = np.sqrt((data.center**2).sum(1)) * (1 + _SLACK)
    waiting = [(0, 0)]
    while waiting:
        q, p = waiting.pop()
        bound = (
            float(queries.center[q] @ data.center[p])
            + q_norm[q] * data.radius[p] + p_norm[p] * queries.radius[q]
            + queries.radius[q] * data.radius[p]
        )
        start, stop = int(queries.start[q]), int(queries.stop[q])
        if bound * (1 + np.sign(bound) * _SLACK) + 1e-3 < best.worst(start, stop):
            continue
        q_kids, p_kids = queries.children[q], data.children[p]
        if not q_kids and not p_kids:
            a, b = int(data.start[p]), int(data.stop[p])
            # Products of these integers are exact in double precision.
            scores = queries.points[start:stop].astype(np.float64) @ data.points[a:b].T.astype(np.float64)
            best.offer(start, stop, scores.astype(np.int64), data.ids[a:b])
        elif p_kids and (not q_kids or data.radius[p] >= queries.radius[q]):
            # The most promising child is taken first, so the k-th scores rise early.
            gain = data.center[p_kids] @ queries.center[q] + q_norm[q] * data.radius[p_kids]
            waiting.extend((q, p_kids[n]) for n in np.argsort(gain))
        else:
            waiting.extend((kid, p) for kid in q_kids)


def quantised(
    df: DataFrame, id_col: str, vector_col: str, scale: int, width: int | None = None
) -> tuple[DataFrame, int, float]:
    """id, v (array of longs) of the rows that take part, their width and a bound of their norms.

    The width is the most common one, unless it is given.
    """
    scaled = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.forall(
        F.col(vector_col),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    rows = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(fine).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(scaled, lambda x: F.floor(x)).cast("array<long>").alias("v"),
        F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
    )
    rows = written(rows, "vectors")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max("norm").alias("norm"))
    if width is not None:
        widths = widths.where(F.col("w") == width)
    most = widths.orderBy(F.desc("n"), "w").first()
    width, norm = (most["w"], most["norm"]) if most else (width or 0, 0.0)
    # A floor moves a component by less than one.
    return rows.where(F.size("v") == width).select("id", "v"), width, norm + math.sqrt(width)


def _centers(rows: DataFrame, count: int, sample: int) -> np.ndarray:
    """Farthest points of a bounded sample, the first ``sample`` rows by a hash."""
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()
    points = np.array([r["v"] for r in some], dtype=np.float64)
    if not len(points):
        return points
    chosen = [points[0]]
    nearest = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(points[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``rows`` with center, the number of the nearest one, and its distance."""

    def assign(frames):
        for frame in frames:
            if len(frame):
                points = np.stack(frame["v"].to_numpy()).astype(np.float64)
                square = (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)
                nearest = square.argmin(1)
                far = np.sqrt(((points - centers[nearest]) ** 2).sum(1))
                yield frame.assign(center=nearest.astype(np.int32), far=far * (1 + _SLACK))

    return rows.mapInPandas(assign, "id long, v array<long>, center int, far double")


def _sharded(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with ``name``: the number of a shard of about ``size`` rows of one centre."""
    counts = rows.groupBy("center").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / size).cast("long")
    return rows.join(F.broadcast(counts.select("center", parts.alias("parts"))), "center").select(
        "id", "v", "center", "far",
        (F.col("center") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", "v", F.lit(3)), "parts")).alias(name),
    )


def shared_blocks(counts: dict[int, int], block_rows: int) -> dict[int, int]:
    """Block of each centre with fewer than ``block_rows`` queries: such centres share blocks."""
    blocks, held, block = {}, 0, 0
    for center, n in sorted(counts.items()):
        if n < block_rows:
            if held + n > block_rows:
                held, block = 0, block + 1
            blocks[center], held = -1 - block, held + n
    return blocks


def _block(group: Column, shared: dict[int, int], group_rows: int, block_rows: int) -> Column:
    """Block of a group: as many groups of one centre as hold about ``block_rows`` queries, or the
    block that its centre shares."""
    part, per_block = F.pmod(group, F.lit(1 << 32)), max(1, block_rows // group_rows)
    own = group - part + F.floor(part / per_block)
    if not shared:
        return own
    places = F.create_map(*[F.lit(x).cast("long") for pair in shared.items() for x in pair])
    return F.coalesce(places[F.shiftright(group, 32)], own)


def wanted_pairs(near: DataFrame, shard_of: DataFrame) -> DataFrame:
    """``(block, shard)`` of the shards that some group of a block has to search, beside its first
    one. Only these copies of a shard's vectors are made."""
    pairs = near.select("block", "first", "center").distinct().join(shard_of, "center")
    return pairs.where("shard <> first").select("block", "shard").distinct()


def _searched(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Best k of each query of a pair, over the rows of a shard. Both sides hold ``pair``."""

    def search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        def points(frame):
            return np.stack(frame["v"].to_numpy()).astype(np.int64)
        queries = queries.sort_values("id")
        floors = dict(zip(queries["id"], queries["kth"]))
        q = build_cover_tree(points(queries), queries["id"].to_numpy())
        d = build_cover_tree(points(data), data["id"].to_numpy())
        floor = np.array([floors[i] for i in q.ids], dtype=np.int64)
        best = Best(q, k, floor)
        dual_search(q, d, best)
        found = best.score > np.iinfo(np.int64).min
        row, _ = np.nonzero(found)
        return pd.DataFrame(
            {"query_id": q.ids[row], "vec_id": best.id[found], "score": best.score[found]}
        )

    return (
        left.groupBy("pair").cogroup(right.groupBy("pair"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    centers: int = 16,
    sample: int = 4096,
    shard_rows: int = 4096,
    group_rows: int = 1024,
    block_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``df`` for each row of ``queries``.

    ``sample`` bounds the rows the centres are chosen from; ``shard_rows`` and ``block_rows`` bound the
    rows and the queries that a task holds, ``group_rows`` the queries that are pruned together.
    """
    data, width, data_norm = quantised(df, id_col, vector_col, scale)
    asked, _, asked_norm = quantised(queries, id_col, vector_col, scale, width)
    if data_norm * asked_norm >= MAX_PRODUCT:
        raise ValueError(f"inner products of {data_norm * asked_norm:g} and more are not exact")
    middle = _centers(data, centers, sample)
    if not len(middle):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = written(_sharded(_assigned(data, middle), shard_rows, "shard"), "data-shards")
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    asked = written(_sharded(_assigned(asked, middle), group_rows, "group"), "query-groups")
    # Round one: a shard of the own centre (any, if the centre has none).
    shards = data.groupBy("center").agg(F.min("shard").alias("shard"), F.max("far").alias("radius"))
    shards = {r["center"]: (r["shard"], r["radius"]) for r in shards.collect()}
    any_shard = min(s for s, _ in shards.values())
    own = F.create_map(*[F.lit(x) for c, (s, _) in shards.items() for x in (c, s)])
    first = F.coalesce(own[F.col("center")], F.lit(any_shard))
    # A block, whole groups of one centre or all of some small ones, and a shard meet in one task.
    counts = {r["center"]: r["n"] for r in asked.groupBy("center").agg(F.count("*").alias("n")).collect()}
    block = _block(F.col("group"), shared_blocks(counts, block_rows), group_rows, block_rows)
    asked = asked.withColumns({"block": block, "first": first})
    pair = F.struct("block", "shard").alias("pair")
    lowest = -(1 << 62)
    firsts = asked.select(F.col("first").alias("shard"), "block").distinct()
    seen = written(
        _searched(
            asked.withColumn("shard", F.col("first")).select(pair, "id", "v", F.lit(lowest).alias("kth")),
            data.join(firsts, "shard").select(pair, "id", "v"), k,
        ),
        "first-round",
    )
    kth = seen.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("kth")
    )
    asked = written(
        asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left").fillna({"kth": lowest}), "asked"
    )
    # Round two: every centre whose bound reaches the group's worst k-th score.
    norms = np.sqrt((middle**2).sum(1))
    products = middle @ middle.T
    rows = [
        F.array(
            *[
                F.struct(F.lit(c).alias("center"), F.lit(float(products[m, c])).alias("product"),
                         F.lit(float(norms[c])).alias("norm"), F.lit(float(r)).alias("radius"))
                for c, (_, r) in sorted(shards.items())
            ]
        )
        for m in range(len(middle))
    ]
    norm = F.array(*[F.lit(float(x)) for x in norms])[F.col("center")]
    groups = asked.groupBy("group", "center", "block", "first").agg(F.max("far").alias("far"), F.min("kth").alias("kth"))
    bound = (
        F.col("c.product") + norm * F.col("c.radius") + F.col("c.norm") * F.col("far")
        + F.col("far") * F.col("c.radius")
    )
    near = written(
        groups.select("group", "center", "block", "first", "far", "kth", F.explode(F.array(*rows)[F.col("center")]).alias("c"))
        .where(bound + F.abs(bound) * _SLACK + 1e-3 >= F.col("kth"))
        .select("group", "block", "first", F.col("c.center").alias("center")),
        "near-centres",
    )
    shard_of = data.select("center", "shard").distinct()
    wanted = wanted_pairs(near, shard_of)
    more = _searched(
        asked.select("group", "id", "v", "kth")
        .join(near, "group").join(shard_of, "center").where("shard <> first")
        .select(pair, "id", "v", "kth"),
        data.join(wanted, "shard").select(pair, "id", "v"), k,
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        seen.union(more)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
