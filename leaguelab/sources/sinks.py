"""Versioned publication and run reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.fingerprint import fingerprint
from ..operators.gates import DOMAINS, PUBLISH, RETAIN


def content_hash(df: DataFrame) -> DataFrame:
    """One row ``rows, content_hash``, independent of row order and partitioning.

    Every row is hashed on its own and the hashes are summed, so nothing is sorted or collected.
    """
    row = fingerprint(*sorted(df.columns))
    # The whole digest: four sums of 64 bits.
    part = lambda n: F.conv(F.substring(row, 16 * n + 1, 16), 16, 10).cast("decimal(38,0)")
    names = [f"_{n}" for n in range(4)]
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(part(n)).alias(name) for n, name in enumerate(names)]
    )
    return sums.select("rows", fingerprint("rows", *names).alias("content_hash"))


MANIFEST = "run long, domains map<string,struct<folder:string,content_hash:string>>"


def _newest_run(spark: SparkSession, target: str):
    """Newest row of the manifest, or None before the first run. Other faults than a missing
    manifest are raised."""
    try:
        runs = spark.read.schema(MANIFEST).json(f"{target}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return runs.orderBy(F.desc("run")).head()


def publish_run(
    frames: Mapping[str, DataFrame], target: str, ready: bool = True
) -> list[str]:
    """Publish the changed domains of a run together; returns their names.

    Every frame is evaluated once, into a folder of its own, and hashed from what was written. Then
    one manifest row names the folder of every domain, so readers see all of a run or nothing of
    it; earlier rows and folders stay. A run that is not ready (see ``run_decision``) writes nothing.
    """
    if not ready or not frames:
        return []
    spark = next(iter(frames.values())).sparkSession
    last = _newest_run(spark, target)
    domains = {k: tuple(v) for k, v in last["domains"].items()} if last else {}
    changed = []
    for domain, df in frames.items():
        folder = f"{domain}/data-{uuid.uuid4().hex}"
        df.write.parquet(f"{target}/{folder}")
        written = spark.read.schema(df.schema).parquet(f"{target}/{folder}")
        version = content_hash(written).head()["content_hash"]
        if domains.get(domain, (None, None))[1] != version:
            domains[domain] = (folder, version)
            changed.append(domain)
    if changed:
        run = last["run"] + 1 if last else 1
        row = spark.createDataFrame([(run, domains)], MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{target}/manifest")
    return changed


def publish(df: DataFrame, target: str, domain: str) -> bool:
    """Publish one domain if its content changed; returns whether it did."""
    return publish_run({domain: df}, target) == [domain]


def published_version(df_or_spark, target: str, domain: str) -> str | None:
    """Content hash of what readers of a domain see, or None."""
    last = _newest_run(getattr(df_or_spark, "sparkSession", df_or_spark), target)
    return last["domains"][domain]["content_hash"] if last and domain in last["domains"] else None


def read_published(spark, target: str, domain: str) -> DataFrame:
    """Current version of a domain."""
    last = _newest_run(spark, target)
    if last is None or domain not in last["domains"]:
        raise ValueError(f"domain {domain} is not published")
    return spark.read.parquet(f"{target}/{last['domains'][domain]['folder']}")


def run_report(
    results: DataFrame, started_at: str, finished_at: str, domains: Sequence[str] = tuple(DOMAINS)
) -> DataFrame:
    """One-row report: times, duration, decisions in fixed order, success flag.

    ``results`` has one decision row per domain. A finish before the start raises an error.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in domains]), F.col("domain"))
    item = F.struct(
        order.alias("no"), F.col("domain"), F.col("decision"), F.col("effective_season"), F.col("reasons")
    )
    start, end = F.to_timestamp(F.lit(started_at)), F.to_timestamp(F.lit(finished_at))
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    checked = F.when(
        seconds < 0, F.raise_error(F.lit("the run finished before it started")).cast("bigint")
    ).otherwise(seconds)
    ok = F.coalesce(F.bool_and(F.col("decision").isin(PUBLISH, RETAIN)), F.lit(False))
    known = results.where(F.col("domain").isin(list(domains)))
    return known.agg(
        F.array_sort(F.collect_list(item)).alias("domains"),
        (ok & (F.count_distinct("domain") == len(domains))).alias("success"),
    ).select(
        F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"),
        checked.alias("duration_seconds"), "success",
        F.transform(
            "domains",
            lambda x: F.struct(x["domain"].alias("domain"), x["decision"].alias("decision"),
                               x["effective_season"].alias("season"), x["reasons"].alias("reasons")),
        ).alias("domains"),
    )


def write_report(results: DataFrame, path: str, started_at: str, finished_at: str) -> dict:
    """Write the report as JSON and return it."""
    report = run_report(results, started_at, finished_at)
    report.coalesce(1).write.mode("overwrite").json(path)
    return json.loads(report.select(F.to_json(F.struct("*")).alias("j")).head()["j"])
