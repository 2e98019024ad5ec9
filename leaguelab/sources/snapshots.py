"""Reading snapshot payloads and player history."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.matches import match_lines

_PAYLOAD = r"(?s)^\s*(?:window\.([A-Za-z_]\w*)\s*=\s*)?(.*?)\s*;?\s*$"

LEAGUES = (
    "leagues map<string, struct<url: string, match_days: map<string, string>, table: string>>, "
    "last_updated string"
)


def strict_json_issue(c: Column) -> Column:
    """Why a JSON text is not strict: duplicate keys, NaN or Infinity, or syntax; else NULL."""

    def apply(values: pd.Series) -> pd.Series:
        import json

        def no_duplicates(pairs):
            if len({k for k, _ in pairs}) != len(pairs):
                raise ValueError("duplicate key")
            return dict(pairs)

        def no_constant(name):
            raise ValueError("constant")

        def issue(text):
            if not isinstance(text, str):
                return "missing"
            try:
                json.loads(text, object_pairs_hook=no_duplicates, parse_constant=no_constant)
            except json.JSONDecodeError:
                return "syntax"
            except ValueError as error:
                return str(error)
            return None

        return values.map(issue)

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, StringType())(c)


def parse_snapshot(texts: DataFrame, text: str, name: str, schema: str | StructType) -> DataFrame:
    """Parse plain JSON, or ``window.NAME = <json>;`` with the expected name.

    Adds ``data`` and ``issue``; ``data`` is NULL where there is an issue.
    """
    keep = [c for c in texts.columns if c != text]
    split = texts.select(
        *keep,
        F.nullif(F.regexp_extract(text, _PAYLOAD, 1), F.lit("")).alias("_name"),
        F.regexp_extract(text, _PAYLOAD, 2).alias("_json"),
    )
    wrong = F.coalesce(F.col("_name") != name, F.lit(False))
    checked = split.withColumn(
        "issue", F.when(wrong, "wrong name").otherwise(strict_json_issue(F.col("_json")))
    )
    return checked.select(
        *keep,
        F.when(F.col("issue").isNull(), F.from_json("_json", schema)).alias("data"),
        "issue",
    )


def read_snapshot(spark: SparkSession, path: str, name: str, schema: str | StructType) -> DataFrame:
    """Snapshot files of a folder, one row per file: path, data, issue."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    return parse_snapshot(files, "text", name, schema)


def league_lines(snapshots: DataFrame) -> DataFrame:
    """Match lines of league snapshots: league, round_name, line_no, line."""
    leagues = snapshots.select(F.explode("data.leagues").alias("league", "_l"))
    rounds = leagues.select("league", F.explode("_l.match_days").alias("round_name", "text"))
    return match_lines(rounds)


def _by_season(segments: DataFrame):
    # A season is spread by player, so one that holds most rows is not one task.
    return (
        segments.repartition("season_start", "player_id")
        .sortWithinPartitions("season_start", "player_id")
        .write.mode("overwrite")
        .partitionBy("season_start")
    )


def write_history(segments: DataFrame, path: str) -> None:
    """Write history segments, one folder per season start, clustered by player."""
    _by_season(segments).option("partitionOverwriteMode", "static").parquet(path)


def replace_seasons(segments: DataFrame, path: str) -> None:
    """Replace the seasons that ``segments`` holds; the folders of all other seasons stay."""
    _by_season(segments).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_history(spark: SparkSession, path: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """Read history segments; ``seasons`` prunes the folders that are read."""
    out = spark.read.parquet(path)
    return out.where(F.col("season_start").isin(list(seasons))) if seasons else out


def import_history(payloads: DataFrame, column: str = "histories") -> DataFrame:
    """Explode a map of player id to season records into one row per record."""
    return payloads.select(F.explode(column).alias("player_id", "_records")).select(
        "player_id", F.posexplode("_records").alias("position", "r")
    ).select("player_id", "position", "r.*")
