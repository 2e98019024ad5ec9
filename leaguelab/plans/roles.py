"""Role views: the star-schema tables seen as leagues, players, matches and snapshots.

Every view covers its whole source table. The ``*_SQL`` texts define the same views for the
checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import CLASSES
from ..lineage import cut_lineage
from ..operators.history import build_segments, segment_id

CLASS_LABELS = [*CLASSES, "Mixklasse"]
_LABEL_SQL = "[" + ", ".join(f"'{c}'" for c in CLASS_LABELS) + "]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def class_label(ordinal):
    return F.element_at(F.array(*[F.lit(c) for c in CLASS_LABELS]), (ordinal + 1).cast("int"))


# --- round results: one row per player, season and round ------------------------------------

ROUNDS_SQL = f"""
rounds AS (
  SELECT r.player_id, r.season_start, r.round, r.points,
    CASE WHEN r.points IS NULL THEN CASE WHEN r.n % 2 = 1 THEN 'd' ELSE 'x' END END AS marker,
    CAST((p.p_size + r.season_start % 2) % 5 AS INTEGER) AS class_ord,
    {_LABEL_SQL}[CAST((p.p_size + r.season_start % 2) % 5 AS INTEGER) + 1] AS class
  FROM (
    SELECT l_partkey AS player_id, CAST(year(l_shipdate) AS INTEGER) AS season_start,
      CAST(month(l_shipdate) AS BIGINT) AS round,
      CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS BIGINT) AS points,
      count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3
  ) r JOIN part p ON p.p_partkey = r.player_id
)"""


def rounds(spark: SparkSession, folder: str) -> DataFrame:
    """player_id, season_start, round, points, marker, class_ord, class."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("player_id"),
        F.year("l_shipdate").alias("season_start"),
        F.month("l_shipdate").cast("bigint").alias("round"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("_q"),
    )
    played = lines.groupBy("player_id", "season_start", "round").agg(
        F.sum("_q").cast("bigint").alias("points"), F.count(F.lit(1)).alias("_n")
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("player_id"), "p_size")
    ordinal = ((F.col("p_size") + F.col("season_start") % 2) % 5).cast("int")
    return (
        played.join(part, "player_id")
        .withColumn("class_ord", ordinal)
        .select(
            "player_id", "season_start", "round", "points",
            F.when(
                F.col("points").isNull(), F.when(F.col("_n") % 2 == 1, "d").otherwise("x")
            ).alias("marker"),
            "class_ord",
            class_label(F.col("class_ord")).alias("class"),
        )
    )


# --- player seasons: one row per player and season ------------------------------------------

SEASONS_SQL = (
    ROUNDS_SQL
    + """,
player_seasons AS (
  SELECT player_id, season_start, class_ord, class AS league,
    CAST(coalesce(sum(points), 0) AS BIGINT) AS points, count(points) AS appearances,
    CAST(player_id % 7 + season_start % 5 AS INTEGER) AS rank
  FROM rounds GROUP BY 1, 2, 3, 4
)"""
)


def player_seasons(spark: SparkSession, folder: str) -> DataFrame:
    """player_id, season_start, class_ord, league, points, appearances, rank (0 = not ranked)."""
    grouped = rounds(spark, folder).groupBy(
        "player_id", "season_start", "class_ord", F.col("class").alias("league")
    )
    return grouped.agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.count("points").alias("appearances"),
    ).withColumn("rank", (F.col("player_id") % 7 + F.col("season_start") % 5).cast("int"))


# --- history segments: a player-season may have several clubs and classes --------------------

SEGMENTS_SQL = f"""
segment_rounds AS (
  SELECT r.player_id, r.season_start, r.season_start + 1 AS season_end, r.club_no, r.round,
    r.points, p.p_name AS name,
    CAST((p.p_size + r.season_start % 2 + r.bump) % 5 AS INTEGER) AS class_ord,
    {_LABEL_SQL}[CAST((p.p_size + r.season_start % 2 + r.bump) % 5 AS INTEGER) + 1] AS league,
    CAST((r.player_id + r.season_start + r.bump) % 9 AS BIGINT) AS rank
  FROM (
    SELECT l_partkey AS player_id, CAST(year(l_shipdate) AS INTEGER) AS season_start,
      CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN 1 ELSE 0 END AS bump,
      CAST(CASE WHEN l_linenumber >= 6 THEN l_suppkey % 25 ELSE l_partkey % 25 END AS VARCHAR)
        AS club_no,
      CAST(month(l_shipdate) AS BIGINT) AS round,
      CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS BIGINT) AS points
    FROM lineitem GROUP BY 1, 2, 3, 4, 5
  ) r JOIN part p ON p.p_partkey = r.player_id
),
segments AS (
  SELECT player_id, season_start, season_end, name, league, class_ord, club_no, rank,
    CAST(coalesce(sum(points), 0) AS BIGINT) AS points, count(points) AS appearances,
    CAST(coalesce(max(CASE WHEN points IS NOT NULL THEN round END), -1) AS BIGINT) AS last_round,
    (count(points) > 0 AND class_ord <= 3) AS eligible
  FROM segment_rounds GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
),
overlap AS (
  SELECT DISTINCT player_id, season_start FROM (
    SELECT player_id, season_start, class_ord, club_no, round
    FROM segment_rounds WHERE points IS NOT NULL AND class_ord <= 3
    GROUP BY 1, 2, 3, 4, 5 HAVING min(points) <> max(points)
  )
),
history AS (
  SELECT s.*, (o.player_id IS NOT NULL) AS ambiguous
  FROM segments s LEFT JOIN overlap o USING (player_id, season_start)
),
totals AS (
  SELECT player_id, season_start, season_end, class_ord, CAST(sum(points) AS BIGINT) AS points,
    CAST(sum(appearances) AS BIGINT) AS appearances, count(*) AS segments
  FROM history WHERE eligible AND NOT ambiguous GROUP BY 1, 2, 3, 4
)"""


def segment_key():
    """Id of a segment from the columns that tell it; it is cheaper to make than to move or write."""
    return segment_id("player_id", "season_start", "class_ord", "club_no")


def segment_rounds(spark: SparkSession, folder: str, once: bool = False) -> DataFrame:
    """Long form of the history: one row per segment and round.

    ``once`` writes the sums of the rounds, for plans that read them several times.
    """
    bump = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 40), 1).otherwise(0)
    club = F.when(F.col("l_linenumber") >= 6, F.col("l_suppkey") % 25).otherwise(
        F.col("l_partkey") % 25
    )
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("player_id"),
        F.year("l_shipdate").alias("season_start"),
        bump.alias("_bump"),
        club.cast("string").alias("club_no"),
        F.month("l_shipdate").cast("bigint").alias("round"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("_q"),
    )
    played = lines.groupBy("player_id", "season_start", "_bump", "club_no", "round").agg(
        F.sum("_q").cast("bigint").alias("points")
    )
    played = cut_lineage(played, "rounds") if once else played
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), "p_size", F.col("p_name").alias("name")
    )
    ordinal = ((F.col("p_size") + F.col("season_start") % 2 + F.col("_bump")) % 5).cast("int")
    return (
        played.join(part, "player_id")
        .withColumn("class_ord", ordinal)
        .select(
            "player_id", "season_start", (F.col("season_start") + 1).alias("season_end"),
            segment_key().alias("segment_id"),
            "name", class_label(F.col("class_ord")).alias("league"), "class_ord", "club_no",
            ((F.col("player_id") + F.col("season_start") + F.col("_bump")) % 9).alias("rank"),
            "round", "points",
        )
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return build_segments(segment_rounds(spark, folder))


# --- matches: one row per order line ----------------------------------------------------------

MATCHES_SQL = """
matches AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_partkey AS part_id,
    l.l_suppkey AS supp_id, l.l_shipdate AS starts_at,
    CAST(year(l.l_shipdate) AS INTEGER) AS season_start,
    CAST(month(l.l_shipdate) AS BIGINT) AS round,
    r.r_name AS league, hn.n_name AS home, an.n_name AS away,
    l.l_linestatus = 'F' AS played,
    CASE WHEN l.l_linestatus = 'F' THEN CAST(floor(l.l_quantity / 3) AS BIGINT) END AS home_score,
    CASE WHEN l.l_linestatus = 'F' THEN 16 - CAST(floor(l.l_quantity / 3) AS BIGINT) END
      AS away_score
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation hn ON hn.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = hn.n_regionkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation an ON an.n_nationkey = s.s_nationkey
)"""


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """order_id, line_no, part_id, supp_id, starts_at, season_start, round, league, home, away,
    played, home_score, away_score."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_name").alias("home"),
        F.col("r_name").alias("league"),
    )
    away = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("away"))
    sides = (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .join(
            table(spark, folder, "customer").select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .join(home, "c_nationkey")
        .select("o_orderkey", "home", "league")
    )
    guests = table(spark, folder, "supplier").join(away, "s_nationkey").select("s_suppkey", "away")
    score = F.floor(F.col("l_quantity") / 3).cast("bigint")
    played = F.col("l_linestatus") == "F"
    return (
        table(spark, folder, "lineitem")
        .join(sides, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(guests, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supp_id"),
            F.col("l_shipdate").alias("starts_at"),
            F.year("l_shipdate").alias("season_start"),
            F.month("l_shipdate").cast("bigint").alias("round"),
            "league", "home", "away",
            played.alias("played"),
            F.when(played, score).alias("home_score"),
            F.when(played, 16 - score).alias("away_score"),
        )
    )


def with_ctes(*views: str) -> str:
    """WITH clause of the given view texts."""
    return "WITH " + ",".join(views) + "\n"
