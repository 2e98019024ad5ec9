"""Queries: history segments, containers and their gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from .registry import query
from .roles import SEGMENTS_SQL, segment_rounds, segments, table, with_ctes

_H = with_ctes(SEGMENTS_SQL)
_ORDER = "coalesce(class_ord, 4), lower(league), club_no, rank"


@query("F6_preview_eligible", _H + """
SELECT player_id, season_start, class_ord, club_no, points, appearances, last_round, eligible
FROM segments""")
def _eligible(spark, d):
    return segments(spark, d).select(
        "player_id", "season_start", "class_ord", "club_no", "points", "appearances",
        "last_round", "eligible",
    )


@query("A4_season_class_totals", _H + "SELECT * FROM totals")
def _totals(spark, d):
    long = segment_rounds(spark, d)
    return H.season_class_totals(H.usable_history(H.build_segments(long), long))


@query("A6_merge_segments", _H + """
SELECT player_id, season_start, CAST(sum(points) AS BIGINT) AS points, min(rank) AS rank,
  count(*) AS segments, max(ambiguous) AS round_overlap_ambiguous
FROM history GROUP BY 1, 2""")
def _merge(spark, d):
    long = segment_rounds(spark, d)
    return H.merge_segments(H.build_segments(long), long).select(
        "player_id", "season_start", "points", "rank", "segments", "round_overlap_ambiguous"
    )


@query("A7_ambiguity", with_ctes(SEGMENTS_SQL) + """
SELECT s.player_id, s.season_start, count(DISTINCT lower(s.club_no)) > 1 AS identity_ambiguous,
  max(s.ambiguous) AS round_overlap_ambiguous FROM history s GROUP BY 1, 2""")
def _ambiguity(spark, d):
    long = segment_rounds(spark, d).withColumn("name", F.concat(F.lit("Club "), F.col("club_no")))
    return H.flag_ambiguity(H.build_segments(long), long)


@query("W9_primary_segment", _H + """
SELECT player_id, season_start, last_round, appearances FROM (SELECT *, row_number() OVER (
  PARTITION BY player_id, season_start ORDER BY last_round DESC, appearances DESC) AS rn
  FROM segments) WHERE rn = 1""")
def _primary(spark, d):
    rows = segments(spark, d)
    picked = H.primary_segment(rows).select(*H.SEASON, F.col("primary_segment_id").alias("segment_id"))
    return rows.join(picked, H.SEGMENT).select(*H.SEASON, "last_round", "appearances")


@query("W10_segment_order", _H + f"""
SELECT player_id, season_start, class_ord, club_no, CAST(row_number() OVER (
  PARTITION BY player_id, season_start ORDER BY {_ORDER}) AS INTEGER) AS segment_no FROM segments""")
def _order(spark, d):
    return H.order_segments(segments(spark, d)).select(
        "player_id", "season_start", "class_ord", "club_no", "segment_no"
    )


@query("W11_latest_affiliation", _H + """
SELECT player_id, season_start,
  CASE WHEN max(m) >= 0 AND count(DISTINCT club_no) FILTER (last_round = m) = 1
    THEN min(club_no) FILTER (last_round = m) END AS club_no,
  NOT (max(m) >= 0 AND count(DISTINCT club_no) FILTER (last_round = m) = 1) AS ambiguous
FROM (SELECT *, max(last_round) OVER (PARTITION BY player_id, season_start) AS m FROM segments)
GROUP BY 1, 2""")
def _affiliation(spark, d):
    return H.latest_affiliation(segments(spark, d))


@query("A24_history_metrics", _H + """
SELECT 'segments' AS metric, count(*) AS value FROM history
UNION ALL SELECT 'eligible_segments', count(*) FROM history WHERE eligible
UNION ALL SELECT 'totals_only_segments', count(*) FROM history WHERE appearances = 0
UNION ALL SELECT 'player_seasons', count(*) FROM (SELECT DISTINCT player_id, season_start FROM history)
UNION ALL SELECT 'ambiguous_seasons', count(*) FROM (
  SELECT DISTINCT player_id, season_start FROM history WHERE ambiguous)
UNION ALL SELECT 'marker_rounds', count(*) FROM segment_rounds WHERE points IS NULL
UNION ALL SELECT 'players', count(DISTINCT player_id) FROM history""")
def _metrics(spark, d):
    long = segment_rounds(spark, d)
    return H.history_metrics(H.usable_history(H.build_segments(long), long), long)


@query("M1_usable_history", _H + """
SELECT h.player_id, h.season_start, h.class_ord, h.club_no, h.points, h.ambiguous FROM history h
WHERE h.player_id NOT IN (SELECT player_id FROM segments WHERE points > 120)""")
def _usable(spark, d):
    long = segment_rounds(spark, d)
    rows = H.build_segments(long).withColumn(
        "rank", F.when(F.col("points") > 120, -1).otherwise(F.col("rank"))
    )
    return H.usable_history(rows, long).select(
        "player_id", "season_start", "class_ord", "club_no", "points", "ambiguous"
    )


@query("Q4_row_gate", """
SELECT p_partkey AS player_id, CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END
  + CASE WHEN p_brand = 'Brand#7' THEN 1 ELSE 0 END + CASE WHEN p_size < 0 THEN 1 ELSE 0 END
  AS failed FROM part""")
def _rows(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("player_id"),
        F.lit(2000).alias("season_start"),
        F.when(F.col("p_size") % 10 == 0, 2003).otherwise(2001).alias("season_end"),
        F.col("p_size").cast("bigint").alias("rank"),
        F.lit(1).cast("bigint").alias("points"),
        F.col("p_type").alias("league"),
        F.when(F.col("p_brand") == "Brand#7", "12 3").otherwise(F.col("p_name")).alias("name"),
    )
    return H.check_rows(rows).select("player_id", F.size("reasons").alias("failed"))


@query("Q5_evidence_gate", _H + """,
seq AS (SELECT player_id, season_start, class_ord, club_no,
  row_number() OVER (PARTITION BY player_id, season_start, class_ord, club_no ORDER BY round) AS pos,
  round, points FROM segment_rounds),
facts AS (SELECT player_id, season_start, class_ord, club_no, max(round) AS hi, count(*) AS n
  FROM seq GROUP BY 1, 2, 3, 4)
SELECT s.player_id, s.season_start, s.class_ord, s.club_no,
  CASE WHEN f.hi <> f.n THEN 1 ELSE 0 END
  + CASE WHEN s.rank = 3 THEN 1 ELSE 0 END AS failed
FROM segments s JOIN facts f USING (player_id, season_start, class_ord, club_no)""")
def _evidence(spark, d):
    long = segment_rounds(spark, d)
    mean = F.when(F.col("appearances") > 0, F.col("points") / F.col("appearances")).otherwise(0.0)
    wrong = F.when(F.col("rank") == 3, mean + 1e-6).otherwise(mean)
    rows = H.build_segments(long).withColumn("points_per_appearance", wrong)
    return H.check_evidence(rows, long).select(
        "player_id", "season_start", "class_ord", "club_no", F.size("reasons").alias("failed")
    )


@query("Q6_container_gate", _H + """
SELECT player_id, season_start, CASE WHEN min(rank) = 4 THEN 1 ELSE 0 END
  + CASE WHEN sum(points) > 100 THEN 1 ELSE 0 END AS failed
FROM segments GROUP BY 1, 2""")
def _containers(spark, d):
    long = segment_rounds(spark, d)
    made = H.merge_segments(H.build_segments(long), long)
    stored = made.withColumn(
        "rank", F.when(F.col("rank") == 4, 5).otherwise(F.col("rank"))
    ).withColumn("points", F.least("points", F.lit(100)))
    return H.check_containers(stored, made).select(
        "player_id", "season_start", F.size("reasons").alias("failed")
    )


@query("Q7_no_loss_gate", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN month(o_orderdate) = 3 THEN 'missing'
  ELSE 'changed' END AS reason
FROM orders WHERE (month(o_orderdate) = 3 OR (month(o_orderdate) = 4 AND o_totalprice < 100000))
  AND o_orderpriority <> '5-LOW'""")
def _no_loss(spark, d):
    previous = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    cheap = (F.month("o_orderdate") == 4) & (F.col("o_totalprice") < 100000)
    candidate = previous.where(F.month("o_orderdate") != 3).withColumn(
        "o_totalprice", F.when(cheap, -1.0).otherwise(F.col("o_totalprice"))
    )
    waivers = previous.where(F.col("o_orderpriority") == "5-LOW")
    return H.check_no_loss(
        previous, candidate, ["o_orderkey"], ["o_orderkey", "o_totalprice"], waivers
    )


@query("Q9_schema_drift", """
SELECT event_id, CAST(1 AS INTEGER) AS unknown FROM events WHERE event_type <> 'click'""")
def _drift(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "props")
    published = events.where(F.col("event_type") == "click")
    return H.check_drift(events, published, ["event_id"], "props", ["season"]).select(
        "event_id", F.size("unknown_fields").alias("unknown")
    )


# --- reading history tables: the cells are the round results, written as text ----------------

_CELLS = """
cells AS (SELECT l_partkey AS player_id, CAST(year(l_shipdate) AS INTEGER) AS season_start,
  l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate,
  CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""


@query("X6_history_rows", with_ctes(_CELLS) + """
SELECT player_id, CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE q END + q AS BIGINT) AS points,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS BIGINT) AS appearances,
  CASE WHEN l_linestatus = 'O' AND l_suppkey % 10 = 3 THEN 'invalid club number'
    WHEN l_linestatus = 'O' AND l_suppkey % 10 = 4 THEN 'blank club number'
    WHEN l_linestatus = 'O' AND l_suppkey % 10 = 5 THEN 'invalid round value'
    WHEN l_linestatus = 'O' AND l_suppkey % 10 = 6 AND q <> 0 THEN 'round total mismatch' END
    AS error,
  count(*) AS rows
FROM cells GROUP BY 1, 2, 3, 4""")
def _history_rows(spark, d):
    headers = ["Pl.", "V-Nr.", "Nr.", "Vorname", "Name", "Gesamt", "R1", "Runde 2", "3"]
    lines = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    first = F.when(F.col("l_returnflag") == "R", F.lit("x")).otherwise(q.cast("string"))
    total = F.when(F.col("l_returnflag") == "R", 0).otherwise(q) + q
    open_line = F.col("l_linestatus") == "O"
    digit = F.col("l_suppkey") % 10
    club = (
        F.when(open_line & (digit == 3), F.lit("12a"))
        .when(open_line & (digit == 4), F.lit(" "))
        .otherwise(F.col("l_suppkey").cast("string"))
    )
    third = F.when(open_line & (digit == 5), F.lit("?")).otherwise(F.lit("VW"))
    shown = F.when(open_line & (digit == 6), total + q).otherwise(total).cast("string")
    rows = lines.select(
        F.year("l_shipdate").alias("table_id"),
        F.col("l_orderkey").alias("row_no"),
        F.concat_ws("/", F.year("l_shipdate"), F.year("l_shipdate") + 1).alias("season"),
        F.lit("A-Klasse").alias("league"),
        F.array(
            F.concat(F.col("l_linenumber").cast("string"), F.lit(".")), club,
            F.col("l_partkey").cast("string"), F.lit("Ann"), F.lit("Example"), shown, first,
            q.cast("string"), third,
        ).alias("cells"),
        q.alias("_q"), total.alias("_total"),
    )
    header = rows.select("table_id").distinct().select(
        "table_id", F.posexplode(F.array(*[F.lit(h) for h in headers])).alias("position", "header")
    )
    parsed = H.parse_history_rows(rows, H.map_history_columns(header))
    mismatch = F.col("error") == "round total mismatch"
    total_rounds = F.aggregate("rounds", F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["points"], F.lit(0)))
    return (
        parsed.withColumn(
            "points", F.when(mismatch, total_rounds).otherwise(F.col("points"))
        )
        .groupBy(F.col("player_id").cast("bigint").alias("player_id"), "points", "appearances", "error")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query("X5_history_columns", """
SELECT p_partkey AS table_id,
  CASE WHEN p_size % 5 = 1 THEN 'duplicate round column' WHEN p_size % 5 = 2
    THEN 'invalid round header' WHEN p_size % 5 = 3 THEN 'missing required column'
    WHEN p_size % 5 = 4 THEN 'incomplete round columns' END AS error,
  CASE WHEN p_size % 5 = 3 THEN NULL ELSE CAST(0 AS INTEGER) END AS rank, CAST(2 AS INTEGER) AS first_name,
  CAST(3 AS INTEGER) AS last_name FROM part""")
def _history_columns(spark, d):
    base = [F.lit("Nr."), F.lit("Vorname"), F.lit("Name"), F.lit("GESAMT")]
    kind = F.col("p_size") % 5
    rank = F.when(kind == 3, F.lit("Team")).otherwise(F.lit("Platz"))
    second = (
        F.when(kind == 1, F.lit("R1")).when(kind == 2, F.lit("Runde"))
        .when(kind == 4, F.lit("R3")).otherwise(F.lit("Runde 2"))
    )
    header = table(spark, d, "part").select(
        F.col("p_partkey").alias("table_id"),
        F.posexplode(F.array(rank, *base, F.lit("r1"), second)).alias("position", "header"),
    )
    return H.map_history_columns(header).select("table_id", "error", "rank", "first_name", "last_name")
