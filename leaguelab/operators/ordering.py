"""Ranks, running sums and de-duplication that hold on skewed groups.

A window over a group is one task, so a group with a third of all rows would not fit. Exact
positions inside such groups come from one global range sort instead: it splits large groups over
many tasks, every task counts its own rows, and one offset per task joins the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut_lineage
from .lookups import lookup

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a task in the low 33 bits


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, name: str = "position"
) -> DataFrame:
    """First ``k`` rows of each group. Spark cuts every group to ``k`` rows before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*[_as_column(c) for c in order])
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def _counted_in_task(names: Sequence[str]):
    """Position and running sums inside each group of a sorted partition; rows keep their places.

    ``_first`` marks the rows of the partition's first group.
    """

    def count(batches):
        key, place, sums, in_first = None, 0, [0] * len(names), True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("_k1", "_k2")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            sizes = np.diff(np.r_[starts, size])
            goes_on = tuple(keys[:, 0]) == key
            of_first = sizes[0] if in_first and (key is None or goes_on) else 0
            in_first = of_first == size
            local = np.arange(1, size + 1) - np.repeat(starts, sizes)
            out = [local]
            for name in names:
                values = pc.fill_null(batch.column(f"_v_{name}"), 0).to_numpy()
                run = np.cumsum(values)
                out.append(run - np.repeat(run[starts] - values[starts], sizes))
            if goes_on:
                for column, before in zip(out, [place, *sums]):
                    column[: sizes[0]] += before
            key, place, sums = tuple(keys[:, -1]), out[0][-1], [c[-1] for c in out[1:]]
            first = pa.array(np.arange(size) < of_first)
            columns = [*batch.columns, first, *[pa.array(c, type=pa.int64()) for c in out]]
            fields = [*batch.schema.names, "_first", "_local", *[f"_c_{n}" for n in names]]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return count


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    running: dict[str, Column] | None = None,
    name: str = "position",
    totals: bool = False,
) -> DataFrame:
    """Exact 1-based position in each group, and running sums (whole numbers, NULL adds nothing).

    ``order`` must be total inside a group. For every ``running`` item ``n`` the result has the
    inclusive running sum ``n``. Rows move once, by the range sort, and are counted where it put them:
    only the first group of a task can have begun in another one, so what comes before it is one lookup
    value per task. ``totals`` adds the group's size (``{name}_count``) and ``{n}_total``, by a join on
    group and task, so that large groups stay spread.
    """
    running = running or {}
    by, names = list(by), list(running)
    hashed = [x for c in by for x in (F.col(c), F.col(c).isNull())] or [F.lit(0)]
    ordered = df.select(
        "*",
        # 128 bits tell neighbouring groups apart.
        F.xxhash64(*hashed).alias("_k1"), F.xxhash64(F.lit(1), *hashed).alias("_k2"),
        *[v.cast("bigint").alias(f"_v_{n}") for n, v in running.items()],
    ).orderBy(*by, *[_as_column(c) for c in order])
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    rows = ordered.withColumn("_task", F.shiftright("_at", _ROW_BITS).cast("int"))
    if by or running:
        counted = ["_local", *[f"_c_{n}" for n in names]]
        schema = T.StructType(rows.schema.fields + [T.StructField("_first", T.BooleanType())])
        for c in counted:
            schema = schema.add(c, T.LongType())
        rows = rows.mapInArrow(_counted_in_task(names), schema)
    else:
        place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
        rows = rows.withColumns({"_first": F.lit(True), "_local": place})
    rows = cut_lineage(rows, "positions")
    # What a task adds to its first and to its last group.
    piece = F.struct("_k1", "_k2", F.col("_local").alias("_n"), *[f"_c_{n}" for n in names])
    ends = rows.groupBy("_task").agg(
        F.max_by(piece, F.when(F.col("_first"), F.col("_local"))).alias("_a"),
        F.max_by(piece, "_at").alias("_z"),
    )
    pieces = ends.select("_task", F.explode(F.array_distinct(F.array("_a", "_z"))).alias("_p")).select("_task", "_p.*")
    earlier = Window.partitionBy("_k1", "_k2").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    skipped = pieces.select(
        "_task", F.sum("_n").over(earlier).alias("_skip"), *[F.sum(f"_c_{n}").over(earlier).alias(f"_b_{n}") for n in names]
    ).where(F.col("_skip") > 0)
    before = lookup(skipped, ["_task"], F.struct("_skip", *[f"_b_{n}" for n in names]), 1_000_000)
    out = rows.withColumn("_o", F.when(F.col("_first"), before("_task")))
    plus = lambda c, o: F.col(c) + F.coalesce(F.col(f"_o.{o}"), F.lit(0))
    found = [plus("_local", "_skip").alias(name), *[plus(f"_c_{n}", f"_b_{n}").alias(n) for n in names]]
    if not totals:
        return out.select(*df.columns, *found)
    group = Window.partitionBy("_k1", "_k2")
    summed = rows.groupBy("_k1", "_k2", "_task").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names]
    ).select(
        "_k1", "_k2", "_task", F.sum("_n").over(group).alias(f"{name}_count"),
        *[F.sum(f"_s_{n}").over(group).alias(f"{n}_total") for n in names],
    )
    counted = [f"{name}_count", *[f"{n}_total" for n in names]]
    return out.select("_k1", "_k2", "_task", *df.columns, *found).join(
        summed, ["_k1", "_k2", "_task"]
    ).select(*df.columns, name, *names, *counted)


def keep_one(
    df: DataFrame, by: Sequence[str | Column], best: Column, names: Sequence[str] | None = None
) -> DataFrame:
    """The row with the smallest ``best`` of each group, combined before the shuffle."""
    columns = list(names or df.columns)
    keys = [_as_column(c).alias(f"_k{i}") for i, c in enumerate(by)]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), best).alias("_row"))
    return picked.select("_row.*")


def dedupe_first(df: DataFrame, key: Column, position: str) -> DataFrame:
    """Keep the first row of each key; rows without a key all stay."""
    keyed = df.withColumn("_key", key)
    without = keyed.where(F.col("_key").isNull()).drop("_key")
    first = keep_one(
        keyed.where(F.col("_key").isNotNull()), ["_key"], F.col(position), df.columns
    )
    return without.unionByName(first)


def largest_remainder(
    df: DataFrame, by: Sequence[str], share: str, position: str, name: str = "percent"
) -> DataFrame:
    """Round the shares of each group to integers that add up to 100."""
    safe = F.when(~F.isnan(share) & (F.col(share) >= 0), F.col(share)).otherwise(0.0)
    totals = df.groupBy(*by).agg(F.sum(safe).alias("_total"))
    scaled = df.join(totals, list(by)).withColumn(
        "_scaled", safe * 100 / F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)
    )
    parts = scaled.withColumn("_whole", F.floor("_scaled").cast("bigint"))
    order = [(F.col("_scaled") - F.col("_whole")).desc(), F.col(position)]
    ranked = with_position(parts, by, order, {"_filled": F.col("_whole")}, "_rank", totals=True)
    return ranked.select(
        *df.columns,
        (
            F.col("_whole")
            + F.when(F.col("_rank") <= 100 - F.col("_filled_total"), 1).otherwise(0)
        ).alias(name),
    )
