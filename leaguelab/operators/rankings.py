"""Ranking statistics on the long form ``(keys, round, points, marker)``.

One row per player, season and round; ``points`` is NULL for a round without a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import round_value_loose
from ..functions.classes import class_ordinal, class_strength, league_class_loose
from ..functions.text import first_nonblank
from .ordering import keep_one, top_k

KEYS = ("player_id", "season_start")


def _played(long: DataFrame) -> DataFrame:
    return long.where(F.col("points").isNotNull())


def ranking_long(players: DataFrame, keep: Sequence[str], rounds: str = "rounds") -> DataFrame:
    """Explode a map of round labels (R1..) to cells into long rows."""
    exploded = players.select(*keep, F.explode(rounds).alias("_label", "raw"))
    number = F.regexp_extract("_label", r"^R([1-9]\d*)$", 1).try_cast("bigint")
    return (
        exploded.withColumn("round", number)
        .where(F.col("round").isNotNull())
        .select(*keep, "round", "raw", round_value_loose(F.col("raw")).alias("points"))
    )


def player_means(long: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Games and mean of the rounds with a result."""
    return long.groupBy(*keys).agg(
        F.count("points").alias("games"), F.coalesce(F.avg("points"), F.lit(0.0)).alias("mean")
    )


def total_with_compensation(long: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum plus the player's mean for every round marked 'd'."""
    mean = F.coalesce(F.avg("points"), F.lit(0.0))
    marked = F.count_if(F.lower("marker") == "d")
    return long.groupBy(*keys).agg(
        (F.coalesce(F.sum("points"), F.lit(0)) + mean * marked).alias("total")
    )


def league_benchmark(long: DataFrame, league: Sequence[str], player: str) -> DataFrame:
    """Mean of the player means of a league and the best one; players without games count as 0."""
    means = player_means(long, [*league, player])
    return means.groupBy(*league).agg(
        F.count(F.lit(1)).alias("players"),
        F.avg("mean").alias("league_mean"),
        F.max("mean").alias("best_mean"),
    )


def latest_round(long: DataFrame, by: Sequence[str] = ("season_start",)) -> DataFrame:
    """Greatest round in which anyone has a result."""
    return _played(long).groupBy(*by).agg(F.max("round").alias("latest_round"))


def last_rounds(long: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last ``n`` results of each player, ``back`` = 1 for the newest."""
    return top_k(_played(long), keys, [F.col("round").desc()], n, "back")


def trend_last3(long: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the last three results against the season mean; flat under three results."""
    last3 = last_rounds(long, 3, keys).groupBy(*keys).agg(F.avg("points").alias("last3_mean"))
    joined = player_means(long, keys).join(last3, list(keys), "left")
    delta = F.when(F.col("games") >= 3, F.col("last3_mean") - F.col("mean")).otherwise(0.0)
    direction = F.when(delta > 0.5, "up").when(delta < -0.5, "down").otherwise("flat")
    return joined.select(
        *keys, "games", "mean", "last3_mean", delta.alias("delta"), direction.alias("trend")
    )


def form_trend(long: DataFrame, n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last ``n`` results: their mean, the total mean, and second half against first half."""
    last = (
        last_rounds(long, n, keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("round", "points"))).alias("_last"))
        .select(*keys, F.col("_last.points").alias("values"))
    )

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)
        return total / F.size(values)

    values = F.col("values")
    half = F.floor(F.size(values) / 2).cast("int")
    first = mean(F.slice(values, F.lit(1), half))
    second = mean(F.slice(values, half + 1, F.size(values)))
    out = last.withColumn("last_mean", mean(values)).withColumn(
        "_gap", F.when(F.size(values) >= 3, second - first).otherwise(0.0)
    )
    trend = F.when(F.col("_gap") > 0.5, "up").when(F.col("_gap") < -0.5, "down").otherwise("flat")
    means = player_means(long, keys).withColumnRenamed("mean", "total_mean")
    return means.join(out, list(keys), "left").select(
        *keys,
        "values",
        F.coalesce("last_mean", F.lit(0.0)).alias("last_mean"),
        "total_mean",
        F.coalesce(trend, F.lit("flat")).alias("trend"),
    )


def recent_form(long: DataFrame, n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the last ``n`` results."""
    return last_rounds(long, n, keys).groupBy(*keys).agg(F.avg("points").alias("form"))


def form_curve(long: DataFrame, n: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last ``n`` results, each at or above the season mean or below it."""
    return (
        last_rounds(long, n, keys)
        .join(player_means(long, keys).select(*keys, "mean"), list(keys))
        .select(*keys, "round", "points", (F.col("points") >= F.col("mean")).alias("above"))
    )


def matchday_top(
    long: DataFrame,
    k: int = 20,
    season: str = "season_start",
    by: Sequence[str] = ("class",),
    tie: str = "player_id",
) -> DataFrame:
    """Best ``k`` positive scores of the latest round per class; equal scores share a rank."""
    group = [season, *by]
    latest = latest_round(long, [season])
    scores = long.join(latest, [season]).where(
        (F.col("round") == F.col("latest_round")) & (F.col("points") > 0)
    )
    best = top_k(scores, group, [F.col("points").desc(), tie], k)
    shared = Window.partitionBy(*group).orderBy(F.col("points").desc())
    return best.withColumn("display_rank", F.rank().over(shared)).drop("latest_round")


def filter_ranking(
    df: DataFrame,
    query: str = "",
    min_games: int = 0,
    fields: Sequence[str] = ("name", "company", "team", "club_name"),
) -> DataFrame:
    """At least ``min_games`` games and the query in any of the fields, ignoring case."""
    out = df.where(F.coalesce("games", F.lit(0)) >= min_games)
    needle = query.strip().lower()
    if not needle:
        return out
    hit = F.lit(False)
    for c in fields:
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return out.where(hit)


def order_ranking(df: DataFrame, sort: str = "official", position: str = "position") -> DataFrame:
    """Order by points, average, games or the official rank; ties by official rank and source."""
    metric = {"points": "total_points", "average": "average", "games": "games"}.get(sort)
    keys = [F.coalesce(F.col(metric), F.lit(0)).desc()] if metric else []
    return df.orderBy(*keys, F.col("official_rank").asc_nulls_last(), position)


def group_people(players: DataFrame) -> DataFrame:
    """Ranking rows of one person with the class records in class order.

    Needs ``person_key``, ``record_key`` and ``class``; a person has one record per class, so the
    collected list is as short as the list of classes.
    """
    rows = players.where(F.col("person_key").isNotNull() & F.col("record_key").isNotNull())
    one = rows.groupBy("person_key", "record_key", "class").agg(F.count(F.lit(1)).alias("n"))
    order = F.coalesce(class_ordinal(F.col("class")), F.lit(99)).alias("o")
    records = F.array_sort(F.collect_list(F.struct(order, "record_key", "class", "n")))
    return one.groupBy("person_key").agg(records.alias("_r")).select(
        "person_key",
        F.col("_r.record_key").alias("record_keys"),
        F.col("_r.class").alias("classes"),
        F.aggregate("_r.n", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("records"),
    )


def club_roster(players: DataFrame, club: str = "club_no") -> DataFrame:
    """Players, distinct known leagues and points of each club."""
    known = F.when(first_nonblank(F.col("league")).isin("", "Unbekannt"), None).otherwise(
        F.col("league")
    )
    return players.groupBy(club).agg(
        F.count(F.lit(1)).alias("players"),
        F.count_distinct(known).alias("active_leagues"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
    )


def order_club_roster(players: DataFrame, club: str = "club_no") -> DataFrame:
    """Roster order: club, class strength, official rank (unknown last)."""
    return players.orderBy(
        club,
        class_strength(F.col("league")).desc(),
        F.coalesce("rank", F.lit(999)),
        "player_id",
    )


def snapshot_stats(lines: DataFrame, league: str = "league", text: str = "line") -> DataFrame:
    """Match lines (more than ten characters) per league."""
    return lines.groupBy(league).agg(
        F.count_if(F.length(F.trim(text)) > 10).alias("match_lines")
    )


def attach_personal_scores(schedule: DataFrame, rounds: DataFrame) -> DataFrame:
    """Personal round score for matches of the player's ranked class.

    ``schedule``: player_id, season_start, round, league, ...; ``rounds``: player_id,
    season_start, round, class, points.
    """
    keyed = schedule.withColumn("_class", league_class_loose(F.col("league")))
    scores = rounds.select(
        "player_id", "season_start", "round", F.col("class").alias("_class"),
        F.col("points").alias("personal_points"),
    )
    return keyed.join(scores, ["player_id", "season_start", "round", "_class"], "left").drop(
        "_class"
    )


def best_league_row(players: DataFrame, position: str = "position") -> DataFrame:
    """One row per player id: the league with most points, first on ties."""
    return keep_one(players, ["player_id"], F.struct(-F.col("points"), F.col(position)))
