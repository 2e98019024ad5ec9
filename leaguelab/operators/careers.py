"""Career, all-time and head-to-head statistics on player-season rows.

A row has ``player_id, season_start, season, class_ord, league, rank, points``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import half_up
from ..functions.classes import CLASSES, class_name
from .ordering import keep_one, top_k, with_position

NO_RANK = 999  # fixed value: order of a missing rank


def career(history: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Points, titles, best season, highest class and seasons of each player.

    The best season is the earliest one with the greatest positive points. Rows of ``current``
    count like finished seasons, but win no title.
    """
    rows = history.withColumn("_title", F.col("rank") == 1)
    if current is not None:
        rows = rows.unionByName(current.withColumn("_title", F.lit(False)))
    best = F.when(F.col("points") > 0, F.struct(-F.col("points"), F.col("season_start")))
    known = F.when(F.col("class_ord").between(0, len(CLASSES) - 1), F.col("class_ord"))
    return (
        rows.groupBy("player_id")
        .agg(
            F.sum("points").alias("total_points"),
            F.count_if("_title").alias("titles"),
            F.max(F.greatest("points", F.lit(0))).alias("best_points"),
            F.min_by("season_start", best).alias("best_season"),
            F.min(known).alias("_high"),
            F.count(F.lit(1)).alias("seasons"),
        )
        .withColumn("highest_class", class_name(F.col("_high")))
        .drop("_high")
    )


def add_current_season(history: DataFrame, ranking: DataFrame) -> DataFrame:
    """Add the current ranking as a season of its own.

    A player in several leagues adds the league with most points; a player who already has that
    season adds nothing.
    """
    best = keep_one(ranking, ["player_id"], F.struct(-F.col("points"), F.col("league")))
    fresh = best.join(
        history.select("player_id", "season_start"), ["player_id", "season_start"], "left_anti"
    )
    return history.unionByName(fresh.select(*history.columns))


def all_time(history: DataFrame) -> DataFrame:
    """Totals, mean per season, best rank and best points with season and league."""
    rank = F.coalesce(F.nullif("rank", F.lit(0)), F.lit(NO_RANK))
    points = F.coalesce("points", F.lit(0))
    with_rank = F.when(rank < NO_RANK, F.struct(rank, F.col("season_start")))
    with_points = F.when(points > 0, F.struct(-points, F.col("season_start")))
    return history.groupBy("player_id").agg(
        F.sum(points).alias("total_points"),
        F.count(F.lit(1)).alias("seasons"),
        (F.sum(points) / F.count(F.lit(1))).alias("mean_points"),
        F.min(rank).alias("best_rank"),
        F.min_by("season_start", with_rank).alias("best_rank_season"),
        F.min_by("league", with_rank).alias("best_rank_league"),
        F.max(F.greatest(points, F.lit(0))).alias("max_points"),
        F.min_by("season_start", with_points).alias("max_points_season"),
        F.min_by("league", with_points).alias("max_points_league"),
    )


def career_trend(history: DataFrame, delta: int = 5) -> DataFrame:
    """Last season against the one before: up or down by more than ``delta`` points."""
    last = top_k(history, ["player_id"], [F.col("season_start").desc()], 2, "_back")
    pair = last.groupBy("player_id").agg(
        F.max(F.when(F.col("_back") == 1, F.col("points"))).alias("last_points"),
        F.max(F.when(F.col("_back") == 2, F.col("points"))).alias("previous_points"),
    )
    gap = F.col("last_points") - F.col("previous_points")
    return pair.withColumn(
        "trend", F.when(gap > delta, "up").when(gap < -delta, "down").otherwise("stable")
    )


def rank_all_time(table: DataFrame, mode: str = "points", query: str | None = None) -> DataFrame:
    """Global rank in one of four orders, given before the name filter.

    Uses one range sort over all players, not a single-task window.
    """
    orders: dict[str, list[Column]] = {
        "points": [F.col("total_points").desc()],
        "mean": [F.col("mean_points").desc()],
        "best_rank": [F.col("best_rank").asc()],
        "seasons": [F.col("seasons").desc(), F.col("total_points").desc()],
    }
    ranked = with_position(table, [], [*orders[mode], F.col("player_id")], name="global_rank")
    if query:
        ranked = ranked.where(F.lower("name").contains(query.lower()))
    return ranked


def overview(history: DataFrame) -> DataFrame:
    """Players, distinct seasons, and players with as many seasons as there are."""
    seasons = history.agg(F.count_distinct("season_start")).scalar()
    per_player = history.groupBy("player_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_player.withColumn("_all", seasons).agg(
        F.max("_all").alias("seasons"),
        F.count(F.lit(1)).alias("players"),
        F.count_if(F.col("_n") >= F.col("_all")).alias("veterans"),
    )


def head_to_head(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Win share of ``left_id`` against ``right_id``.

    ``stats`` has player_id, mean, form and seasons. 0.4 mean + 0.5 form + 0.1 seasons, each as
    a / (a + b); a side without a mean gets 0.2; clamped to 0.05..0.95.
    """

    def side(prefix: str) -> DataFrame:
        return stats.select(
            F.col("player_id").alias(f"{prefix}_id"),
            *[F.col(c).alias(f"_{prefix}_{c}") for c in ("mean", "form", "seasons")],
        )

    joined = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")

    def value(prefix: str, c: str) -> Column:
        return F.coalesce(F.col(f"_{prefix}_{c}"), F.lit(0)).cast("double")

    def share(c: str) -> Column:
        a, b = value("left", c), value("right", c)
        return F.when(a + b == 0, 0.5).otherwise(F.try_divide(a, a + b))

    raw = 0.4 * share("mean") + 0.5 * share("form") + 0.1 * share("seasons")
    no_left, no_right = value("left", "mean") == 0, value("right", "mean") == 0
    share1 = (
        F.when(no_left & no_right, 0.5).when(no_left, 0.2).when(no_right, 0.8).otherwise(raw)
    )
    joined = joined.withColumn("left_share", F.greatest(F.lit(0.05), F.least(F.lit(0.95), share1)))
    return joined.select(
        *pairs.columns,
        "left_share",
        (1 - F.col("left_share")).alias("right_share"),
        half_up(F.col("left_share") * 100).alias("left_percent"),
        half_up((1 - F.col("left_share")) * 100).alias("right_percent"),
    )


def head_to_head_facts(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Seasons, titles, highest class, best points and best rank of both sides of each pair."""
    facts = career(history).join(
        all_time(history).select("player_id", "best_rank", "best_rank_season"), "player_id"
    )
    columns = [
        "seasons", "titles", "highest_class", "best_points", "best_rank", "best_rank_season",
    ]

    def side(prefix: str) -> DataFrame:
        return facts.select(
            F.col("player_id").alias(f"{prefix}_id"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
        )

    return pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
