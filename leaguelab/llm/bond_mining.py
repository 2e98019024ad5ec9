"""Hard negatives by vertical scans: vectors kept by dimension, candidates shrunk by score bounds.

For every anchor the best other rows of its label are its positives; the hard negatives of a positive are
the best rows of other labels whose score lies in a window below that of the positive. Scores are integer
inner products of quantised vectors.

A part of the data is held by columns, one for each dimension, with the smallest and the largest value of
each. An anchor reads the columns in the order of its own magnitudes, largest first. After every step a
candidate's score lies between its partial sum plus the least and plus the most that the columns not yet
read can add; candidates whose bounds miss every window, or fall below the k-th best that others reach for
certain, leave the bitmap, and later columns are read for the rest only. What is left after the last column
has exact scores. Bounds are sums of integers, so nothing is lost by rounding.

Parts are dealt out evenly, whatever the labels are, and hold ``part_rows`` rows at most. A task holds one
part; the anchors, which are the stated query set, stream past it in batches, so neither their number nor
the size of the data bounds what a task holds. Two passes: positives first, then the windows that follow
from them. A pass gives at most k rows for an anchor (and window) and part.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor
do rows whose width is not the most common one (the smaller of equally common ones) or whose id is null;
rows of the anchor's own id are never its positives or negatives; repeated rows count each; an anchor id
that comes twice is one anchor, the one of the smallest label and vector; ties go to smaller ids; fewer than
k rows give fewer; a negative positive score has an empty window. Scores are exact at every size of the
components: above 2^53 in 64-bit integers, above 2^62 in unbounded ones, and only the result is cut to the
range of a long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, written

_LONG = np.iinfo(np.int64)
FOUND = "anchor long, slot int, vec_id long, score long"


class VerticalPart:
    """Rows of a part by columns, in the type that keeps all partial sums exact."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, largest: int):
        """``columns`` (dimension x row); ``largest`` bounds every component of rows and anchors."""
        bound = largest * largest * max(1, len(columns))
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(columns.astype(self.kind))
        some = columns.shape[1] > 0
        self.least = self.columns.min(axis=1) if some else self.columns.sum(axis=1)
        self.most = self.columns.max(axis=1) if some else self.columns.sum(axis=1)

    def first_in_windows(
        self, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int
    ) -> Iterator[tuple[int, int, int]]:
        """(window, id, score): the first ``k`` rows of ``alive`` in each window (low, high)."""
        anchor = anchor.astype(self.kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.most])[:, order]
        # What the columns not yet read add at least and at most.
        rest_low = ends.min(axis=0)[::-1].cumsum()[::-1]
        rest_high = ends.max(axis=0)[::-1].cumsum()[::-1]
        partial = np.zeros(len(alive), dtype=self.kind)
        step, read = max(1, len(order) // 8), 0
        while read < len(order) and len(alive):
            dims = order[read : read + step]
            read += len(dims)
            columns = self.columns[dims]
            if len(alive) < columns.shape[1]:
                columns = columns[:, alive]
            partial = partial + anchor[dims] @ columns
            low, high = (rest_low[read], rest_high[read]) if read < len(order) else (0, 0)
            keep = np.zeros(len(alive), dtype=bool)
            for bottom, top in windows:
                within = partial + low <= top
                sure = within & (partial + low >= bottom) & (partial + high <= top)
                if np.count_nonzero(sure) > k:
                    certain = np.sort(partial[sure])[-k] + low
                    bottom = max(bottom, certain)
                keep |= within & (partial + high >= bottom)
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
        for n, (bottom, top) in enumerate(windows):
            inside = np.flatnonzero((partial >= bottom) & (partial <= top))
            if len(inside) > 4 * k:
                bar = np.sort(partial[inside])[-k]
                inside = inside[partial[inside] >= bar]
            best = sorted((-int(partial[i]), int(self.ids[alive[i]])) for i in inside)[:k]
            for score, vec_id in best:
                yield n, vec_id, min(max(-score, _LONG.min), _LONG.max)


def quantised_rows(
    df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int
) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that take part, and the largest magnitude of a component."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    fine = F.forall(
        F.col(vector_col),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    rows = written(
        df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & label.isNotNull())
        .where(fine)
        .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")),
        "mining-rows",
    )
    width = (
        rows.groupBy(F.size("v").alias("w")).agg(
            F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")
        ).orderBy(F.desc("n"), "w").first()
    )
    if width is None:
        return rows, 0
    largest = max(abs(width["low"] or 0), abs(width["high"] or 0))
    return rows.where(F.size("v") == width["w"]), largest


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _scan(same_label: bool, k: int, largest: int):
    """Batches ordered by part, its rows before the anchors, to the best of each anchor."""

    def one_part(held: list[pa.RecordBatch]) -> VerticalPart:
        ids, labels, columns = (
            np.concatenate([b.column("id").to_numpy() for b in held]),
            np.concatenate([b.column("label").to_numpy() for b in held]),
            np.concatenate([_vectors(b.column("v")) for b in held]).T,
        )
        return VerticalPart(ids, labels, columns, largest)

    def answers(part: VerticalPart, anchors: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        vectors = _vectors(anchors.column("v"))
        windows = anchors.column("windows").to_pylist()
        for n, (anchor, label) in enumerate(
            zip(anchors.column("id").to_pylist(), anchors.column("label").to_pylist())
        ):
            wanted = (part.labels == label) == same_label
            alive = np.flatnonzero(wanted & (part.ids != anchor))
            asked = [(w["low"], w["high"]) for w in windows[n]]
            for window, vec_id, score in part.first_in_windows(vectors[n], alive, asked, k):
                for column, value in zip(out, (anchor, windows[n][window]["slot"], vec_id, score)):
                    column.append(value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(out, types)], names=["anchor", "slot", "vec_id", "score"]
        )

    def scan(batches):
        number, held, part = None, [], None
        for batch in batches:
            # A batch may hold the end of one part and the beginning of another.
            parts = batch.column("part").to_numpy()
            anchors = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((parts[1:] != parts[:-1]) | (anchors[1:] != anchors[:-1])) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if parts[start] != number:
                    number, held, part = parts[start], [], None
                if not anchors[start]:
                    held.append(piece)
                elif held or part:
                    if part is None:
                        part, held = one_part(held), []
                    for first in range(0, piece.num_rows, 1_000):
                        yield answers(part, piece.slice(first, 1_000))

    return scan


def _dealt(rows: DataFrame, part_rows: int) -> tuple[DataFrame, int]:
    """``rows`` with part, dealt evenly and written, and the number of parts."""
    count = rows.count()
    spark = rows.sparkSession
    # Small tables are cut finer, so that all cores have a part.
    wide = min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(count, 2_048))
    parts = max(parts_for(count, part_rows), wide)
    # Even for copies of one row: the number of the row in its task counts, not its content.
    at = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts))
    return written(rows.withColumn("part", at.cast("int")), "mining-parts"), parts


def _pass(parted: DataFrame, parts: int, anchors: DataFrame, same_label: bool, k: int, largest: int) -> DataFrame:
    """anchor, slot, vec_id, score: the first ``k`` of each window (slot, low, high) of each anchor."""
    windows = "array<struct<slot: int, low: long, high: long>>"
    columns = ["part", "asks", "id", "label", "v", "windows"]
    data = parted.withColumns({"asks": F.lit(False), "windows": F.lit(None).cast(windows)}).select(columns)
    asked = anchors.withColumns(
        {"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "asks": F.lit(True)}
    ).select(columns)
    found = (
        data.union(asked)
        .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "asks")
        .mapInArrow(_scan(same_label, k, largest), FOUND)
    )
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    anchors: Column | str,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = 256,
    part_rows: int = 1 << 17,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the rows. A negative of a positive of score s has a score t with
    low_percent * s <= 100 * t <= high_percent * s. ``part_rows`` bounds the rows that a task holds.
    """
    label = F.col(label) if isinstance(label, str) else label
    chosen = F.expr(anchors) if isinstance(anchors, str) else anchors
    rows, largest = quantised_rows(df, id_col, vector_col, label, scale)
    parted, parts = _dealt(rows, part_rows)
    picked = df.where(chosen & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    asked = rows.join(picked.distinct(), "id", "left_semi").groupBy("id").agg(
        F.min(F.struct("label", "v")).alias("row")
    )
    everything = F.array(
        F.struct(F.lit(0).alias("slot"), F.lit(_LONG.min).alias("low"), F.lit(_LONG.max).alias("high"))
    )
    asked = written(asked.select("id", "row.label", "row.v", everything.alias("windows")), "mining-anchors")
    best = written(_pass(parted, parts, asked, True, positives, largest), "mining-positives")
    # The least t with low * s <= 100 t and the largest with 100 t <= high * s, in whole numbers.
    s = F.col("score").cast("decimal(38,0)")
    windows = best.where("score >= 0").groupBy("anchor").agg(
        F.collect_list(
            F.struct(
                F.col("rank").alias("slot"),
                F.ceil(s * low_percent / 100).cast("long").alias("low"),
                F.floor(s * high_percent / 100).cast("long").alias("high"),
            )
        ).alias("windows")
    )
    again = asked.drop("windows").join(windows.withColumnRenamed("anchor", "id"), "id")
    found = _pass(parted, parts, again, False, negatives, largest)
    return found.withColumnRenamed("slot", "place").join(
        best.select(
            "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        ["anchor", "place"],
    ).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
