"""Small tables that rows read without a shuffle.

A table of a few hundred rows, such as class means by season, is joined to billions of rows by a key
with a handful of values. As a shuffle that join would send all rows to a handful of tasks. Here the
table is one scalar value, a hash table in an array, and a row looks its key up in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
MAX_ROWS = 100_000


def lookup(
    df: DataFrame, keys: Sequence[str], value: Column, max_rows: int = MAX_ROWS
) -> Callable[..., Column]:
    """Function from key columns to ``value`` of the row of ``df`` with these keys, or NULL.

    NULL keys are equal to each other. ``df`` has one row per key. The query fails with an error if ``df`` has more than ``max_rows`` rows, so the scalar stays bounded.
    """
    types = [df.schema[k].dataType for k in keys]

    def key(columns: Sequence[str | Column]) -> Column:
        parts = [F.col(c) if isinstance(c, str) else c for c in columns]
        return F.struct(*[p.cast(t).alias(f"k{i}") for i, (p, t) in enumerate(zip(parts, types))])

    def bucket(k: Column) -> Column:
        return F.pmod(F.xxhash64(*[k[f"k{i}"] for i in range(len(types))]), F.lit(BUCKETS)).cast("int")

    entries = df.select(key(keys).alias("key"), value.alias("value"))
    filled = entries.groupBy(bucket(F.col("key")).alias("_b")).agg(
        F.map_from_entries(
            F.collect_list(F.struct("key", "value"))
        ).alias("_rows")
    )
    one = filled.agg(
        F.map_from_entries(F.collect_list(F.struct("_b", "_rows"))).alias("_m"),
        F.coalesce(F.sum(F.size("_rows")), F.lit(0)).alias("_n"),
    )
    slots = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.col("_m")[i])
    too_many = F.raise_error(F.lit(f"a lookup table has more than {max_rows} rows"))
    table = one.select(F.when(F.col("_n") > max_rows, too_many).otherwise(slots)).scalar()

    def find(*columns: str | Column) -> Column:
        wanted = key(columns)
        return F.get(table, bucket(wanted))[wanted]

    return find


def one_row(df: DataFrame) -> Column:
    """All columns of the only row of ``df`` as a struct."""
    return df.select(F.struct(*df.columns)).scalar()


def dealt_join(
    rows: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join with a table that has few rows a key, where a key may hold a third of ``rows``.

    ``rows`` are dealt over ``salts`` places by the columns ``spread``; ``few`` is copied to each.
    """
    places = F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    return dealt.join(few.withColumn("_salt", F.explode(places)), [*on, "_salt"], how).drop("_salt")
