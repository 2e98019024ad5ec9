"""Lower weighted medians from histograms, for groups of any size.

No rows are sorted or moved to the task of their group. One pass counts the rows of a group by bins of
the value (64 to an octave, so no range has to be known) and by weight; the counts are summed before the
shuffle. They tell the bin in which the running weight reaches half of the total. A second pass sums the
weights of the values in that bin only, and the first value that reaches half is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import lookup

PER_OCTAVE = 64
_SMALLEST = 1_100 * PER_OCTAVE  # below the logarithm of every double
_LAST = 1 << 30


def bin_of(value: Column) -> Column:
    """Number of the value's bin; it never falls as the value rises. NaN is the largest value."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + _SMALLEST
    return (
        F.when(F.isnan(v) | (v == float("inf")), _LAST)
        .when(v == float("-inf"), -_LAST)
        .when(v > 0, size)
        .when(v < 0, -size)
        .otherwise(0)
        .cast("int")
    )


def _half_count(n: Column) -> Column:
    """Place of the lower median of ``n`` values."""
    return F.floor((n - 1) / 2) + 1


def weighted_medians(
    df: DataFrame, by: Sequence[str], value: str, weight: str, cap: bool = False
) -> DataFrame:
    """One row per group: median, total_weight and facts of its rows.

    The median is the smallest value whose running weight reaches half of the total. With ``cap`` a
    weight counts at most twice the lower median of the group's weights; a weight has few distinct
    values then. Weights are not negative; NULL values are left out. The facts are: observations,
    raw_total_weight, weight_median, weight_cap, capped, min_value, max_value. The number of groups
    is bounded by the lookup.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.col(weight).alias("_raw"))
    rows = rows.withColumn("_bin", bin_of(F.col("_v")))
    # Counts by bin and weight: bounded by the bins and weights there are, not by the rows.
    split = [*by, "_bin", *(["_raw"] if cap else [])]
    counts = rows.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_raw").alias("_sum"),
        F.min("_v").alias("_low"), F.max("_v").alias("_high"),
    )
    group = Window.partitionBy(*by)
    whole = {"weight_median": F.lit(None), "weight_cap": F.lit(None), "_w": F.col("_sum")}
    if cap:
        upto = F.sum("_n").over(group.orderBy("_raw").rangeBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(group)})
        middle = F.min(F.when(F.col("_upto") >= _half_count(F.col("_all")), F.col("_raw"))).over(group)
        counts = counts.withColumn("weight_median", middle)
        whole = {"weight_cap": F.col("weight_median") * 2,
                 "_w": F.least("_raw", F.col("weight_median") * 2) * F.col("_n")}
    counts = counts.withColumns(whole)
    run = F.sum("_w").over(group.orderBy("_bin").rangeBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_run": run, "_total": F.sum("_w").over(group)})
    reached = F.col("_run") * 2 >= F.col("_total")
    above = F.col("weight_cap") < F.col("_raw") if cap else F.lit(False)
    facts = counts.groupBy(*by).agg(
        F.sum("_n").alias("observations"), F.max("_total").alias("total_weight"),
        F.sum("_sum").alias("raw_total_weight"), F.max("weight_median").alias("weight_median"),
        F.max("weight_cap").alias("weight_cap"),
        F.coalesce(F.sum(F.when(above, F.col("_n"))), F.lit(0)).alias("capped"),
        F.min("_low").alias("min_value"), F.max("_high").alias("max_value"),
        F.min(F.when(reached, F.col("_bin"))).alias("_bin"),
        F.max(F.when(~reached, F.col("_run"))).alias("_before"),
    )
    names = [c for c in facts.columns if c not in by]
    found = lookup(facts, by, F.struct(*names))
    near = rows.withColumn("_f", found(*by)).where(F.col("_bin") == F.col("_f._bin"))
    counted = F.least("_raw", "_f.weight_cap") if cap else F.col("_raw")
    left = near.groupBy(*by, "_v").agg(F.sum(counted).alias("_w"), F.first("_f").alias("_f"))
    upto = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = F.coalesce(F.col("_f._before"), F.lit(0)) + F.sum("_w").over(upto)
    return (
        left.withColumn("_run", run)
        .where(F.col("_run") * 2 >= F.col("_f.total_weight"))
        .groupBy(*by)
        .agg(F.min("_v").alias("median"), F.min_by("_f", "_v").alias("_f"))
        .select(*by, "median", *[F.col(f"_f.{n}").alias(n) for n in names if not n.startswith("_")])
    )
