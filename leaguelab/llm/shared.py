"""Shared folder, written intermediates and input columns of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="leaguelab-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leaguelab-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written once to the shared folder.

    Cuts the lineage: a lost executor costs the unfinished tasks only, and no reader computes the
    rows again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` as long and ``text``; other columns, also of clashing names, are left behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def sliced(batches, most: int = 1_000):
    """Arrow batches of at most ``most`` rows, so that the Python objects of a batch stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def in_train(id_col, parts: int, held_out: int):
    """Whether crc32 of the id as text, modulo ``parts``, is not ``held_out``."""
    key = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % parts != held_out


def parts_for(rows: int, per_part: int) -> int:
    """Number of parts of about ``per_part`` rows."""
    return max(1, -(-rows // per_part))


def bit_map(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Bit map (word, set) of the hashes ``key``: at most ``bits`` / 64 rows, whatever the input."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.select(F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("_bit"))
        .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("set"))
    )


def with_bit(df: DataFrame, key: str, found: DataFrame, bits: int) -> DataFrame:
    """``df`` with _may: whether the bit of ``key`` is set."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    set_here = F.expr("shiftright(set, _bit) & 1L") == 1
    return (
        df.withColumns({"word": F.shiftright(at, 6), "_bit": (at % 64).cast("int")})
        .join(F.broadcast(found), "word", "left")
        .withColumn("_may", F.coalesce(set_here, F.lit(False)))
        .drop("word", "_bit", "set")
    )
