"""Token ids of documents as ORC files: run-length coded integers, row indexes, Bloom filters.

ORC codes an integer column in runs (run-length encoding, version 2: direct, delta and patched
runs), so the ids of a 49,408-word vocabulary take about two bytes each before compression. Every
stripe holds the minimum and maximum of each column, every ``row_stride`` rows have an index entry
of their own, and a Bloom filter over ``doc_id`` answers lookups by id; readers skip stripes and
row groups by these, and several tasks read different stripes of one file.

Defined cases: a null text is an empty one and has the end id only; a null id is kept and sorts
first; repeated ids are kept as rows of their own, in the order of their texts; an empty table
gives empty results; other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import id_and_text, written
from .token_codec import encoded

SCHEMA = "doc_id long, part int, pos int, n_tokens int, ids array<int>"


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
    row_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode whole texts and write them in ascending id order.

    One shuffle, of the texts by id range; the ids are made after it, so they are written where
    they are made. Columns: doc_id, part (range of ids, ascending), pos (in the part), n_tokens,
    ids.
    """

    def tokens(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id")
            start, held, size = 0, [], 0
            for n, ids in encoded(texts, tokenizer, end_id):
                held.append(ids)
                size += len(ids)
                if size >= 16 << 20 or n == len(texts) - 1:
                    lengths = np.array([len(x) // 4 for x in held], dtype=np.int32)
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(held), dtype="<i4"))
                    count = len(held)
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids.slice(start, count),
                            pa.array(np.full(count, part, dtype=np.int32)),
                            pa.array(np.arange(pos, pos + count, dtype=np.int32)),
                            pa.array(lengths),
                            pa.ListArray.from_arrays(pa.array(offsets), values),
                        ],
                        names=["doc_id", "part", "pos", "n_tokens", "ids"],
                    )
                    start, pos, held, size = start + count, pos + count, [], 0

    (
        id_and_text(docs, id_col, text_col)
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(tokens, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` the filter goes to the ORC reader, which skips stripes
    and row groups by their ranges and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every written document, from the ids read back.

    ``start`` is a running sum in two levels: within a part, and over the totals of the parts,
    which are one row per written part.
    """

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = np.asarray(ids.flatten(), dtype="<u4")
            ends = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    batch.column("pos"),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(crc, type=pa.int64()),
                ],
                names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"],
            )

    rows = written(
        read_token_orc(spark, path)
        .select("doc_id", "part", "pos", "ids")
        .mapInArrow(digest, "doc_id long, part int, pos int, n_tokens long, ids_crc32 long"),
        "token-digests",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("part")
        .agg(F.sum("n_tokens").alias("_total"))
        .select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(starts, "part")
        .select(
            "doc_id",
            (F.col("_before") + F.col("_within")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
