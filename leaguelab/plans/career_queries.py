"""Queries: careers, all-time tables and head-to-head comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seasons import season_of_date
from ..operators import careers as C
from ..operators import rankings as R
from .registry import query
from .roles import ROUNDS_SQL, SEASONS_SQL, player_seasons, rounds, table, with_ctes

_S = with_ctes(SEASONS_SQL)
_NEWEST = "(SELECT max(season_start) FROM player_seasons)"

_CAREER_COLUMNS = """
  CAST(sum(points) AS BIGINT) AS total_points,
  CAST(max(greatest(points, 0)) AS BIGINT) AS best_points,
  CAST(arg_min(season_start, CASE WHEN points > 0 THEN {'a': -points, 'b': season_start} END)
    FILTER (points > 0) AS INTEGER) AS best_season,
  ['Bezirksliga', 'A-Klasse', 'B-Klasse', 'C-Klasse'][
    min(CASE WHEN class_ord <= 3 THEN class_ord END) + 1] AS highest_class,
  count(*) AS seasons"""


def _split(spark, d):
    """History before the newest season, and the newest season as current rows."""
    rows = player_seasons(spark, d).select(
        "player_id", "season_start", "class_ord", "league", "rank", "points"
    )
    newest = rows.agg(F.max("season_start")).scalar()
    return rows.where(F.col("season_start") < newest), rows.where(F.col("season_start") == newest)


@query("A8_career", _S + f"""
SELECT player_id, {_CAREER_COLUMNS},
  CAST(sum(CASE WHEN rank = 1 AND season_start < {_NEWEST} THEN 1 ELSE 0 END) AS BIGINT) AS titles
FROM player_seasons GROUP BY 1""")
def _career(spark, d):
    return C.career(*_split(spark, d))


_ALL_TIME = """
all_time AS (
  SELECT player_id, CAST(sum(points) AS BIGINT) AS total_points, count(*) AS seasons,
    sum(points) / count(*) AS mean_points,
    CAST(min(CASE WHEN rank = 0 THEN 999 ELSE rank END) AS INTEGER) AS best_rank,
    CAST(arg_min(season_start, {'a': rank, 'b': season_start}) FILTER (rank > 0) AS INTEGER)
      AS best_rank_season,
    arg_min(league, {'a': rank, 'b': season_start}) FILTER (rank > 0) AS best_rank_league,
    CAST(max(greatest(points, 0)) AS BIGINT) AS max_points,
    CAST(arg_min(season_start, {'a': -points, 'b': season_start}) FILTER (points > 0) AS INTEGER)
      AS max_points_season,
    arg_min(league, {'a': -points, 'b': season_start}) FILTER (points > 0) AS max_points_league
  FROM player_seasons GROUP BY 1
)"""


@query("A9_all_time", with_ctes(SEASONS_SQL, _ALL_TIME) + """
SELECT * REPLACE (round(mean_points, 6) AS mean_points) FROM all_time""")
def _all_time(spark, d):
    return C.all_time(player_seasons(spark, d)).withColumn("mean_points", F.round("mean_points", 6))


@query("A10_add_current_season", with_ctes(SEASONS_SQL, """
hist AS (SELECT * FROM player_seasons WHERE season_start % 2 = 0 OR player_id % 3 <> 0),
best AS (SELECT player_id, season_start, arg_min(league, {'a': -points, 'b': league}) AS league,
  max(points) AS points FROM (
    SELECT l_partkey AS player_id, 1999 AS season_start, l_returnflag AS league,
      CAST(sum(l_quantity) AS BIGINT) AS points FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2)
""") + """
SELECT player_id, season_start, league, points FROM hist
UNION ALL
SELECT player_id, season_start, league, points FROM best
WHERE (player_id, season_start) NOT IN (SELECT (player_id, season_start) FROM hist)""")
def _add_current(spark, d):
    hist = player_seasons(spark, d).where(
        (F.col("season_start") % 2 == 0) | (F.col("player_id") % 3 != 0)
    )
    ranking = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("player_id"), F.col("l_returnflag").alias("league"))
        .agg(F.sum("l_quantity").cast("bigint").alias("points"))
        .withColumn("season_start", F.lit(1999))
    )
    columns = ["player_id", "season_start", "league", "points"]
    return C.add_current_season(hist.select(*columns), ranking.select(*columns))


@query("A11_overview", _S + """
SELECT count(DISTINCT season_start) AS seasons, count(DISTINCT player_id) AS players,
  (SELECT count(*) FROM (SELECT player_id FROM player_seasons GROUP BY 1
    HAVING count(*) >= (SELECT count(DISTINCT season_start) FROM player_seasons))) AS veterans
FROM player_seasons""")
def _overview(spark, d):
    return C.overview(player_seasons(spark, d))


def _rank_query(mode: str, order: str):
    @query(f"W7_rank_all_time_{mode}", with_ctes(SEASONS_SQL, _ALL_TIME) + f"""
SELECT * FROM (SELECT player_id, p_name AS name,
  row_number() OVER (ORDER BY {order}, player_id) AS global_rank
  FROM all_time JOIN part ON p_partkey = player_id) WHERE contains(lower(name), 'red')""")
    def _rank(spark, d):
        names = table(spark, d, "part").select(
            F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name")
        )
        ranked = C.rank_all_time(C.all_time(player_seasons(spark, d)).join(names, "player_id"), mode, "red")
        return ranked.select("player_id", "name", "global_rank")


_rank_query("points", "total_points DESC")
_rank_query("mean", "mean_points DESC")
_rank_query("best_rank", "best_rank")
_rank_query("seasons", "seasons DESC, total_points DESC")


@query("W8_career_trend", _S + """
SELECT player_id, CAST(max(CASE WHEN back = 1 THEN points END) AS BIGINT) AS last_points,
  CAST(max(CASE WHEN back = 2 THEN points END) AS BIGINT) AS previous_points,
  CASE WHEN max(CASE WHEN back = 1 THEN points END) - max(CASE WHEN back = 2 THEN points END) > 5
      THEN 'up'
    WHEN max(CASE WHEN back = 1 THEN points END) - max(CASE WHEN back = 2 THEN points END) < -5
      THEN 'down' ELSE 'stable' END AS trend
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season_start DESC) AS back
  FROM player_seasons) GROUP BY 1""")
def _trend(spark, d):
    return C.career_trend(player_seasons(spark, d))


_PAIRS = """
pairs AS (SELECT l_partkey AS left_id, max(l_suppkey) AS right_id FROM lineitem GROUP BY 1)"""


def _pairs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("left_id")).agg(
        F.max("l_suppkey").alias("right_id")
    )


@query("M16_head_to_head", with_ctes(SEASONS_SQL, _PAIRS, """
last AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season_start DESC, round DESC)
  AS back FROM rounds WHERE points IS NOT NULL AND season_start = (SELECT max(season_start) FROM rounds)),
stats AS (SELECT r.player_id, coalesce(avg(r.points), 0) AS mean,
  (SELECT coalesce(avg(points), 0) FROM last l WHERE l.player_id = r.player_id AND back <= 5)
    AS form,
  (SELECT count(*) FROM player_seasons s WHERE s.player_id = r.player_id
    AND season_start < (SELECT max(season_start) FROM rounds)) AS seasons
  FROM rounds r WHERE season_start = (SELECT max(season_start) FROM rounds) GROUP BY 1),
j AS (SELECT left_id, right_id, coalesce(a.mean, 0) AS m1, coalesce(b.mean, 0) AS m2,
  coalesce(a.form, 0) AS f1, coalesce(b.form, 0) AS f2, coalesce(a.seasons, 0) AS s1,
  coalesce(b.seasons, 0) AS s2 FROM pairs LEFT JOIN stats a ON a.player_id = left_id
  LEFT JOIN stats b ON b.player_id = right_id),
p AS (SELECT left_id, right_id, greatest(0.05, least(0.95, CASE WHEN m1 = 0 AND m2 = 0 THEN 0.5
  WHEN m1 = 0 THEN 0.2 WHEN m2 = 0 THEN 0.8 ELSE
   CAST(0.4 AS DOUBLE) * (CASE WHEN m1 + m2 = 0 THEN 0.5 ELSE m1 / (m1 + m2) END)
   + CAST(0.5 AS DOUBLE) * (CASE WHEN f1 + f2 = 0 THEN 0.5 ELSE f1 / (f1 + f2) END)
   + CAST(0.1 AS DOUBLE) * (CASE WHEN s1 + s2 = 0 THEN 0.5 ELSE s1 / (s1 + s2) END) END)) AS share
  FROM j)""") + """
SELECT left_id, right_id, round(share, 6) AS left_share, round(1 - share, 6) AS right_share
FROM p""")
def _h2h(spark, d):
    all_rounds = rounds(spark, d)
    newest = all_rounds.agg(F.max("season_start")).scalar()
    long = all_rounds.where(F.col("season_start") == newest)
    seasons = (
        player_seasons(spark, d).where(F.col("season_start") < newest)
        .groupBy("player_id").agg(F.count(F.lit(1)).alias("seasons"))
    )
    stats = (
        R.player_means(long, ["player_id"])
        .join(R.recent_form(long, 5, ["player_id"]), "player_id", "left")
        .join(seasons, "player_id", "left")
    )
    return C.head_to_head(_pairs(spark, d), stats).select(
        "left_id", "right_id", F.round("left_share", 6).alias("left_share"),
        F.round("right_share", 6).alias("right_share"),
    )


@query("M17_head_to_head_facts", with_ctes(SEASONS_SQL, _PAIRS, f"""
facts AS (SELECT player_id, {_CAREER_COLUMNS},
  CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS titles,
  CAST(min(CASE WHEN rank = 0 THEN 999 ELSE rank END) AS INTEGER) AS best_rank
  FROM player_seasons GROUP BY 1)""") + """
SELECT left_id, right_id, a.seasons AS left_seasons, a.titles AS left_titles,
  a.highest_class AS left_highest_class, a.best_points AS left_best_points,
  a.best_rank AS left_best_rank, b.seasons AS right_seasons, b.titles AS right_titles,
  b.highest_class AS right_highest_class, b.best_points AS right_best_points,
  b.best_rank AS right_best_rank
FROM pairs LEFT JOIN facts a ON a.player_id = left_id
LEFT JOIN facts b ON b.player_id = right_id""")
def _h2h_facts(spark, d):
    return C.head_to_head_facts(_pairs(spark, d), player_seasons(spark, d)).drop(
        "left_best_rank_season", "right_best_rank_season"
    )


@query("P1c_season_of_date", """
SELECT CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END AS INTEGER)
  AS season_start, count(*) AS orders FROM orders GROUP BY 1""")
def _season_of_date(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(season_of_date(F.col("o_orderdate"))["start"].alias("season_start"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
