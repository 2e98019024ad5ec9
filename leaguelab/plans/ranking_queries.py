"""Queries: ranking statistics over the round results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankings as R
from .registry import query
from .roles import ROUNDS_SQL, SEASONS_SQL, player_seasons, rounds, table, with_ctes

_R = with_ctes(ROUNDS_SQL)
_LAST = ",\nlast AS (SELECT *, row_number() OVER (PARTITION BY player_id, season_start" \
    " ORDER BY round DESC) AS back FROM rounds WHERE points IS NOT NULL)"
_MEANS = ",\nmeans AS (SELECT player_id, season_start, count(points) AS games," \
    " coalesce(avg(points), 0) AS mean FROM rounds GROUP BY 1, 2)"


@query("A1_player_means", _R + """
SELECT player_id, season_start, count(points) AS games, round(coalesce(avg(points), 0), 6) AS mean
FROM rounds GROUP BY 1, 2""")
def _means(spark, d):
    return R.player_means(rounds(spark, d)).withColumn("mean", F.round("mean", 6))


@query("A2_total_with_compensation", _R + """
SELECT player_id, season_start, round(coalesce(sum(points), 0)
  + coalesce(avg(points), 0) * sum(CASE WHEN marker = 'd' THEN 1 ELSE 0 END), 6) AS total
FROM rounds GROUP BY 1, 2""")
def _total(spark, d):
    return R.total_with_compensation(rounds(spark, d)).withColumn("total", F.round("total", 6))


@query("A3_league_benchmark", _R + """
SELECT season_start, class, count(*) AS players, round(avg(mean), 6) AS league_mean,
  round(max(mean), 6) AS best_mean
FROM (SELECT season_start, class, player_id, coalesce(avg(points), 0) AS mean
  FROM rounds GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _benchmark(spark, d):
    out = R.league_benchmark(rounds(spark, d), ["season_start", "class"], "player_id")
    return out.withColumn("league_mean", F.round("league_mean", 6)).withColumn(
        "best_mean", F.round("best_mean", 6)
    )


@query("A12_club_roster", with_ctes(SEASONS_SQL) + """
SELECT CAST(player_id % 25 AS VARCHAR) AS club_no, count(*) AS players,
  count(DISTINCT league) AS active_leagues, CAST(sum(points) AS BIGINT) AS points
FROM player_seasons GROUP BY 1""")
def _roster(spark, d):
    club = (F.col("player_id") % 25).cast("string")
    return R.club_roster(player_seasons(spark, d).withColumn("club_no", club))


@query("A15_snapshot_stats", """
SELECT source AS league,
  CAST(sum(CASE WHEN length(trim(line)) > 10 THEN 1 ELSE 0 END) AS BIGINT) AS match_lines
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def _stats(spark, d):
    lines = table(spark, d, "documents").select(
        F.col("source").alias("league"), F.explode(F.split("text", "\n")).alias("line")
    )
    return R.snapshot_stats(lines)


@query("A16_latest_round", _R + """
SELECT season_start, max(round) AS latest_round FROM rounds WHERE points IS NOT NULL GROUP BY 1""")
def _latest(spark, d):
    return R.latest_round(rounds(spark, d))


@query("W1_trend_last3", _R + _LAST + _MEANS + """
SELECT m.player_id, m.season_start, m.games, round(m.mean, 6) AS mean,
  round(l.m3, 6) AS last3_mean,
  CASE WHEN m.games < 3 THEN 'flat' WHEN l.m3 - m.mean > 0.5 THEN 'up'
    WHEN l.m3 - m.mean < -0.5 THEN 'down' ELSE 'flat' END AS trend
FROM means m LEFT JOIN (SELECT player_id, season_start, avg(points) AS m3 FROM last
  WHERE back <= 3 GROUP BY 1, 2) l USING (player_id, season_start)""")
def _trend(spark, d):
    return R.trend_last3(rounds(spark, d)).select(
        "player_id", "season_start", "games", F.round("mean", 6).alias("mean"),
        F.round("last3_mean", 6).alias("last3_mean"), "trend",
    )


@query("W2_form_trend", _R + _LAST + """,
n5 AS (SELECT *, count(*) OVER (PARTITION BY player_id, season_start) AS n,
  row_number() OVER (PARTITION BY player_id, season_start ORDER BY round) AS pos
  FROM last WHERE back <= 5),
agg AS (SELECT player_id, season_start, max(n) AS n, avg(points) AS last_mean,
  avg(CASE WHEN pos <= n // 2 THEN points END) AS h1,
  avg(CASE WHEN pos > n // 2 THEN points END) AS h2 FROM n5 GROUP BY 1, 2),
means AS (SELECT player_id, season_start, coalesce(avg(points), 0) AS total_mean
  FROM rounds GROUP BY 1, 2)
SELECT player_id, season_start, round(coalesce(last_mean, 0), 6) AS last_mean,
  round(total_mean, 6) AS total_mean,
  CASE WHEN n >= 3 AND h2 - h1 > 0.5 THEN 'up' WHEN n >= 3 AND h1 - h2 > 0.5 THEN 'down'
    ELSE 'flat' END AS trend
FROM means LEFT JOIN agg USING (player_id, season_start)""")
def _form(spark, d):
    return R.form_trend(rounds(spark, d)).select(
        "player_id", "season_start", F.round("last_mean", 6).alias("last_mean"),
        F.round("total_mean", 6).alias("total_mean"), "trend",
    )


@query("W3_recent_form", _R + _LAST + """
SELECT player_id, season_start, round(avg(points), 6) AS form FROM last WHERE back <= 5
GROUP BY 1, 2""")
def _recent(spark, d):
    return R.recent_form(rounds(spark, d)).withColumn("form", F.round("form", 6))


@query("W4_form_curve", _R + _LAST + _MEANS + """
SELECT player_id, season_start, round, points, points >= mean AS above
FROM last JOIN means USING (player_id, season_start) WHERE back <= 8""")
def _curve(spark, d):
    return R.form_curve(rounds(spark, d))


_TOP = _R + """,
latest AS (SELECT season_start, max(round) AS latest_round FROM rounds
  WHERE points IS NOT NULL GROUP BY 1),
scores AS (SELECT r.* FROM rounds r JOIN latest l
  ON l.season_start = r.season_start AND l.latest_round = r.round WHERE points > 0),
top AS (SELECT *,
  row_number() OVER (PARTITION BY season_start, class ORDER BY points DESC, player_id) AS position,
  rank() OVER (PARTITION BY season_start, class ORDER BY points DESC) AS display_rank
  FROM scores)"""


@query("W5_matchday_top", _TOP + """
SELECT season_start, class, round, player_id, points, position, display_rank FROM top
WHERE position <= 20""")
def _top(spark, d):
    return R.matchday_top(rounds(spark, d)).select(
        "season_start", "class", "round", "player_id", "points", "position", "display_rank"
    )


@query("flagship_matchday_report", _TOP + _LAST + _MEANS + """
SELECT t.season_start, t.class, t.round, t.player_id, t.points, t.display_rank, m.games,
  round(m.mean, 6) AS mean,
  CASE WHEN m.games < 3 THEN 'flat' WHEN l.m3 - m.mean > 0.5 THEN 'up'
    WHEN l.m3 - m.mean < -0.5 THEN 'down' ELSE 'flat' END AS trend
FROM top t JOIN means m USING (player_id, season_start)
LEFT JOIN (SELECT player_id, season_start, avg(points) AS m3 FROM last WHERE back <= 3
  GROUP BY 1, 2) l USING (player_id, season_start)
WHERE t.position <= 20""")
def matchday_report(spark, d):
    """Top 20 of the latest round per season and class, with season mean and trend."""
    long = rounds(spark, d)
    trend = R.trend_last3(long).select("player_id", "season_start", "games", "mean", "trend")
    return R.matchday_top(long).join(trend, ["player_id", "season_start"]).select(
        "season_start", "class", "round", "player_id", "points", "display_rank", "games",
        F.round("mean", 6).alias("mean"), "trend",
    )


@query("F2_filter_ranking", with_ctes(SEASONS_SQL) + """
SELECT s.player_id, s.season_start, p.p_name AS name, s.appearances AS games
FROM player_seasons s JOIN part p ON p.p_partkey = s.player_id
WHERE s.appearances >= 3 AND (contains(lower(p.p_name), 'ring') OR contains(lower(p.p_brand), 'ring')
  OR contains(lower(p.p_type), 'ring'))""")
def _filter(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("company"), F.col("p_type").alias("team"),
    )
    joined = player_seasons(spark, d).join(part, "player_id").withColumnRenamed(
        "appearances", "games"
    )
    out = R.filter_ranking(joined, "Ring", 3, ["name", "company", "team"])
    return out.select("player_id", "season_start", "name", "games")


@query("W16_order_ranking_positions", with_ctes(SEASONS_SQL) + """
SELECT player_id, season_start, row_number() OVER (PARTITION BY season_start
  ORDER BY points DESC, CASE WHEN rank = 0 THEN NULL ELSE rank END ASC NULLS LAST, player_id)
  AS place FROM player_seasons""")
def _order(spark, d):
    from ..operators.ordering import with_position

    official = F.nullif("rank", F.lit(0)).asc_nulls_last()
    return with_position(
        player_seasons(spark, d), ["season_start"],
        [F.col("points").desc(), official, "player_id"], name="place",
    ).select("player_id", "season_start", "place")


@query("J10_personal_scores", _R + """
SELECT o.o_orderkey AS order_id, l.l_partkey AS player_id,
  CAST(year(l.l_shipdate) AS INTEGER) AS season_start, CAST(month(l.l_shipdate) AS BIGINT) AS round,
  r.points AS personal_points
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN rounds r ON r.player_id = l.l_partkey AND r.season_start = year(l.l_shipdate)
  AND r.round = month(l.l_shipdate) AND r.class = 'B-Klasse'""")
def _personal(spark, d):
    schedule = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("order_id"), F.col("l_partkey").alias("player_id"),
            F.year("l_shipdate").alias("season_start"),
            F.month("l_shipdate").cast("bigint").alias("round"),
            F.lit("B-Klasse Gruppe 2 2000/01").alias("league"),
        )
    )
    return R.attach_personal_scores(schedule, rounds(spark, d)).select(
        "order_id", "player_id", "season_start", "round", "personal_points"
    )
