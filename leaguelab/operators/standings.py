"""Published standings: table cells ``(league, row_no, cells)`` and ranks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_cup
from ..functions.classes import league_class_loose
from ..functions.seasons import clean, trailing_season
from ..functions.text import club_base_name, squeeze
from .ordering import with_position

# Cell positions of a standings table.
TEAM_CELL, DIFF_CELL, POINTS_CELL, MIN_CELLS = 1, 7, 8, 9


def _cell(i: int) -> Column:
    return F.coalesce(clean(F.get("cells", F.lit(i))), F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def standings(cells: DataFrame) -> DataFrame:
    """Team, points and difference of the rows with more than eight cells."""
    keep = [c for c in cells.columns if c != "cells"]
    return cells.where(F.size("cells") >= MIN_CELLS).select(
        *keep,
        _cell(TEAM_CELL).alias("team"),
        _number(_cell(POINTS_CELL)).alias("points"),
        _number(_cell(DIFF_CELL)).alias("diff"),
    )


def league_leader(cells: DataFrame) -> DataFrame:
    """Team of the first row of each league whose rank cell is 1."""
    first = F.regexp_replace(_cell(0), r"\.", "") == "1"
    rows = cells.where((F.size("cells") > 2) & first)
    return rows.groupBy("league").agg(F.min_by(_cell(TEAM_CELL), "row_no").alias("leader"))


def withdrawn(cells: DataFrame) -> DataFrame:
    """Teams whose row says that they withdrew."""
    text = F.lower(F.array_join("cells", " "))
    rows = cells.where(text.contains("zurückgezogen"))  # fixed value: note of a withdrawn team
    return rows.select("league", _cell(TEAM_CELL).alias("team")).distinct()


def class_team_rank(table: DataFrame) -> DataFrame:
    """Rank of every team among all groups of its class: points, difference, source position.

    A class may hold a large share of all teams, so the rank comes from a range sort.
    """
    keyed = table.withColumn("class", league_class_loose(F.col("league")))
    order = [F.col("points").desc(), F.col("diff").desc(), F.col("league"), F.col("row_no")]
    return with_position(keyed, ["class"], order, name="class_rank", totals=True).withColumnRenamed(
        "class_rank_count", "class_size"
    )


def current_regular_leagues(leagues: DataFrame, name: str = "league") -> DataFrame:
    """Leagues that are no cup and belong to the newest season named at their end."""
    keyed = leagues.withColumn("season", trailing_season(F.col(name))).where(
        ~is_cup(F.col(name)) & F.col("season").isNotNull()
    )
    newest = keyed.agg(F.max("season.start")).scalar()
    return keyed.where(F.col("season.start") == newest)


def tables_mentioning(cells: DataFrame, clubs: DataFrame) -> DataFrame:
    """``(league, club)`` of the league tables in which a cell contains the club or its base name.

    Works on the distinct substrings of a league's cells, as an equi join.
    """
    from .identity import groups_containing

    text = F.lower(squeeze(F.col("cell")))
    spread = cells.where(~is_cup(F.col("league"))).select(
        "league", F.explode("cells").alias("cell")
    ).select("league", text.alias("text")).where(F.col("text") != "")
    names = clubs.select(
        "club",
        F.explode(
            F.array(F.lower(squeeze(F.col("club"))), F.lower(club_base_name(F.col("club"))))
        ).alias("needle"),
    ).where(F.col("needle") != "").distinct()
    found = groups_containing(spread, ["league"], names)
    return found.join(names, "needle").select("league", "club").distinct()


def two_games_per_round(sides: DataFrame) -> DataFrame:
    """Teams with more than one game in a league round."""
    return (
        sides.groupBy("league", "round", "team")
        .agg(F.count(F.lit(1)).alias("games"))
        .where(F.col("games") > 1)
    )
