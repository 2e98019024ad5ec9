"""Structured Streaming forms of the batch operators. These are additions of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.events import CONTENT, STATE, merge_state
from ..operators.ordering import keep_one

EVENT_SCHEMA = (
    "uid string, season string, league string, round_name string, team_id string, team_name string, "
    "opponent string, home_team string, away_team string, is_home boolean, starts_at timestamp_ntz, "
    "location string, location_warning string, status string, fingerprint string, "
    "snapshot_at timestamp"
)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Written state versions, oldest first. Only a missing folder counts as no state; any other
    fault is raised."""
    try:
        table = spark.read.parquet(f"{path}/state")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["version"] for r in table.select("version").distinct().collect())


def _version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/state/version={version}")


def latest_state(spark: SparkSession, path: str) -> DataFrame | None:
    """State of the newest snapshot, or None before the first."""
    versions = _versions(spark, path)
    return _version(spark, path, versions[-1]) if versions else None


def _remove(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def state_merger(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges the snapshots of a batch into the state, in order.

    A state version belongs to a snapshot (its time, in microseconds), whatever batch brought it. A
    snapshot may come as any number of files in any number of batches: its rows so far are kept, and
    when more arrive its version is merged again from the version before it. So a repeated batch
    changes nothing, and all files together give the state of one whole merge. Snapshots older than
    the newest applied one are dropped. Of rows that share their uid within a snapshot, the smallest
    by all columns in schema order counts (NULL is smallest). Two versions are kept, one to merge again from.
    """
    inbox = f"{path}/inbox"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.unix_micros("snapshot_at")
        batch.where(F.col("snapshot_at").isNotNull()).write.mode("overwrite").parquet(
            f"{inbox}/batch={batch_id}"
        )
        versions = _versions(spark, path)
        newest = versions[-1] if versions else None
        held = spark.read.schema(EVENT_SCHEMA + ", batch long").parquet(inbox)
        fresh = held.where(F.col("batch") == batch_id)
        arrived = sorted(
            r["v"] for r in fresh.select(at.alias("v")).distinct().collect()
            if newest is None or r["v"] >= newest
        )
        for version in arrived:
            before = [v for v in versions if v < version]
            events = held.where(at == version).drop("batch")
            events = keep_one(events, ["uid"], F.struct(*events.columns))
            season = events.agg(F.max("season")).head()[0]
            now = F.timestamp_micros(F.lit(version))
            if before:
                prior = _version(spark, path, before[-1]).select(*STATE)
            else:
                prior = events.where(F.lit(False)).select(
                    *CONTENT, "fingerprint", F.lit(0).alias("sequence"),
                    F.lit(None).cast("timestamp").alias("last_modified"),
                )
            merged = merge_state(prior, events.drop("snapshot_at"), F.lit(season), now)
            merged.withColumn("snapshot_at", now).write.mode("overwrite").parquet(
                f"{path}/state/version={version}"
            )
            versions = [v for v in versions if v != version] + [version]
        for old in versions[:-2]:
            _remove(spark, f"{path}/state/version={old}")
        if arrived:
            # Batches without a row of the newest snapshot are not needed to merge it again.
            last = held.groupBy("batch").agg(F.max(at).alias("v")).where(F.col("v") < versions[-1])
            for r in last.collect():
                _remove(spark, f"{inbox}/batch={r['batch']}")

    return merge


def stream_event_state(
    spark: SparkSession, source: str, state: str, checkpoint: str
) -> StreamingQuery:
    """Apply all snapshot files that have arrived to the event state."""
    snapshots = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
    return (
        snapshots.writeStream.foreachBatch(state_merger(state))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_means(
    results: DataFrame, delay: str = "1 hour", width: str = "1 day", time: str = "ts",
    player: str = "player_id", points: str = "points",
) -> DataFrame:
    """Games and mean of each player per time window; results later than ``delay`` are dropped.

    Works on streams and on tables.
    """
    source = results.withWatermark(time, delay) if results.isStreaming else results
    out = source.groupBy(F.window(time, width).alias("w"), player).agg(
        F.count(points).alias("games"), F.avg(points).alias("mean")
    )
    return out.select(F.col("w.start").alias("window_start"), player, "games", "mean")
