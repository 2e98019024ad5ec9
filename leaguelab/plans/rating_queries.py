"""Queries: calibration chain, priors and backtest over the history segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..operators import calibration as K
from ..operators import history as H
from .registry import query
from .roles import SEGMENTS_SQL, segment_rounds, with_ctes

SEASON_ROWS_SQL = """
season_rows AS (
  SELECT h.player_id, h.season_start, h.season_end,
    count(DISTINCT CASE WHEN h.class_ord <= 3 THEN h.class_ord END) AS observed,
    coalesce(max(t.groups), 0) AS groups, max(t.class_ord) AS class_ord, max(t.points) AS points,
    max(t.appearances) AS appearances
  FROM history h LEFT JOIN (SELECT player_id, season_start, count(*) AS groups,
    min(class_ord) AS class_ord, sum(points) AS points, sum(appearances) AS appearances
    FROM totals GROUP BY 1, 2) t USING (player_id, season_start) GROUP BY 1, 2, 3
),
class_means AS (
  SELECT class_ord, season_start, season_end, CAST(sum(points) AS BIGINT) AS points,
    CAST(sum(appearances) AS BIGINT) AS appearances, count(*) AS player_records,
    CAST(sum(points) AS DOUBLE) / CAST(sum(appearances) AS DOUBLE) AS mean
  FROM totals GROUP BY 1, 2, 3
),
neighbours AS (
  SELECT *, lag(season_start) OVER w AS o_start, lag(season_end) OVER w AS o_end,
    lag(observed) OVER w AS o_observed, lag(groups) OVER w AS o_groups,
    lag(class_ord) OVER w AS o_class, lag(points) OVER w AS o_points,
    lag(appearances) OVER w AS o_app
  FROM season_rows WINDOW w AS (PARTITION BY player_id ORDER BY season_start)
),
transitions AS (
  SELECT player_id, o_start AS older_start, season_start, season_end,
    CASE WHEN o_end <> season_start THEN 'nonconsecutive'
      WHEN observed > 1 OR o_observed > 1 THEN 'multiClass'
      WHEN groups <> 1 OR o_groups <> 1 THEN 'incompleteEvidence'
      WHEN class_ord = o_class THEN 'sameClass'
      WHEN abs(class_ord - o_class) <> 1 THEN 'nonAdjacentOrUnknownClass'
      WHEN appearances < 4 OR o_app < 4 THEN 'insufficientAppearances' END AS reason,
    least(class_ord, o_class) AS edge,
    CASE WHEN class_ord < o_class THEN o_points / o_app - points / appearances
      ELSE points / appearances - o_points / o_app END AS value,
    least(appearances, o_app) AS raw_weight
  FROM neighbours WHERE o_start IS NOT NULL
)"""

EDGES_SQL = """
cutoffs AS (SELECT DISTINCT season_start AS cutoff FROM totals),
obs AS (SELECT c.cutoff, t.* FROM transitions t JOIN cutoffs c ON t.season_end <= c.cutoff
  WHERE t.reason IS NULL),
capped AS (SELECT *, least(raw_weight, 2 * quantile_disc(raw_weight, 0.5) OVER (
  PARTITION BY cutoff, edge)) AS weight FROM obs),
running AS (SELECT *, sum(weight) OVER (PARTITION BY cutoff, edge ORDER BY value, player_id,
  older_start ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY cutoff, edge) AS total
  FROM capped),
edges AS (SELECT cutoff, edge, count(*) AS observations, CAST(max(total) AS BIGINT) AS total_weight,
  min(CASE WHEN 2 * run >= total THEN value END) AS "offset" FROM running GROUP BY 1, 2),
edge_rows AS (SELECT cutoff, max(CASE WHEN edge = 0 AND observations >= 8 THEN "offset" END) AS e0,
  max(CASE WHEN edge = 1 AND observations >= 8 THEN "offset" END) AS e1,
  max(CASE WHEN edge = 2 AND observations >= 8 THEN "offset" END) AS e2 FROM edges GROUP BY 1)"""

# targets(player_id, cutoff, target_ord) -> priors
PRIORS_SQL = """
tmeans AS (SELECT t.cutoff, t.target_ord, coalesce(arg_max(m.mean, {'e': m.season_end, 'm': m.mean}),
    1.0) AS target_mean, count(m.mean) > 0 AS mean_available
  FROM (SELECT DISTINCT cutoff, target_ord FROM targets) t
  LEFT JOIN class_means m ON m.class_ord = t.target_ord AND m.season_end <= t.cutoff
    AND m.mean > 0 AND m.mean <= 1000 GROUP BY 1, 2),
last2 AS (SELECT * FROM (SELECT t.player_id, t.cutoff, s.season_start, s.season_end,
  row_number() OVER (PARTITION BY t.player_id, t.cutoff ORDER BY s.season_end DESC) AS back
  FROM (SELECT DISTINCT player_id, cutoff FROM targets) t
  JOIN season_rows s ON s.player_id = t.player_id AND s.season_end <= t.cutoff) WHERE back <= 2),
conv AS (SELECT t.player_id, t.cutoff, t.target_ord, l.back, l.season_start, g.appearances, g.class_ord,
    g.points / g.appearances AS raw,
    CASE WHEN g.class_ord <= 0 AND t.target_ord > 0 THEN e0
      WHEN t.target_ord <= 0 AND g.class_ord > 0 THEN -e0 ELSE 0 END AS s0,
    CASE WHEN g.class_ord <= 1 AND t.target_ord > 1 THEN e1
      WHEN t.target_ord <= 1 AND g.class_ord > 1 THEN -e1 ELSE 0 END AS s1,
    CASE WHEN g.class_ord <= 2 AND t.target_ord > 2 THEN e2
      WHEN t.target_ord <= 2 AND g.class_ord > 2 THEN -e2 ELSE 0 END AS s2
  FROM (SELECT DISTINCT player_id, cutoff, target_ord FROM targets) t
  JOIN last2 l USING (player_id, cutoff) JOIN totals g ON g.player_id = t.player_id
    AND g.season_start = l.season_start LEFT JOIN edge_rows e ON e.cutoff = t.cutoff),
conv2 AS (SELECT *, s0 + s1 + s2 IS NOT NULL AS cal, raw + coalesce(s0 + s1 + s2, 0) AS rating FROM conv),
per_season AS (SELECT player_id, cutoff, target_ord, back, sum(rating * appearances) AS w,
  sum(appearances) AS app, min(cal) AS cal FROM conv2 GROUP BY 1, 2, 3, 4 HAVING min(rating) >= 0),
rated AS (SELECT p.*, (w + 4 * target_mean) / (app + 4) AS r FROM per_season p
  JOIN tmeans USING (cutoff, target_ord)),
blended AS (SELECT player_id, cutoff, target_ord, count(*) AS n,
  max(CASE WHEN back = 1 THEN r END) AS r1, max(CASE WHEN back = 2 THEN r END) AS r2,
  min(cal) AS cal, min(app) AS min_app FROM rated WHERE r > 0 AND r <= 1000 GROUP BY 1, 2, 3),
priors AS (SELECT t.player_id, t.cutoff, t.target_ord,
  coalesce(CASE WHEN n = 2 THEN 0.7::DOUBLE * r1 + 0.3::DOUBLE * r2 ELSE coalesce(r1, r2) END,
    m.target_mean) AS prior, coalesce(n, 0) AS prior_seasons, coalesce(b.cal, false) AS class_calibrated,
  CASE WHEN b.cal THEN CASE WHEN n = 2 AND min_app >= 4 THEN 'medium' ELSE 'provisional' END
    ELSE 'very-low' END AS confidence, m.target_mean
  FROM (SELECT DISTINCT player_id, cutoff, target_ord FROM targets) t
  JOIN tmeans m USING (cutoff, target_ord)
  LEFT JOIN blended b USING (player_id, cutoff, target_ord))"""

_ALL = with_ctes(SEGMENTS_SQL, SEASON_ROWS_SQL)


def history_tables(spark, d):
    """Usable history and its class totals.

    The history feeds several branches of every rating query, so it is written once.
    """
    long = segment_rounds(spark, d)
    history = cut_lineage(H.usable_history(H.build_segments(long), long))
    return history, H.season_class_totals(history)


@query("A5_class_season_means", _ALL + """
SELECT class_ord, season_start, season_end, points, appearances, player_records,
  round(mean, 6) AS mean FROM class_means""")
def _means(spark, d):
    out = K.class_season_means(history_tables(spark, d)[1])
    return out.select(
        "class_ord", "season_start", "season_end", F.col("points").cast("bigint").alias("points"),
        F.col("appearances").cast("bigint").alias("appearances"), "player_records",
        F.round("mean", 6).alias("mean"),
    )


@query("M2_stabilize", _ALL + """
SELECT s.player_id, s.season_start, s.class_ord,
  round((s.points + 4 * m.mean) / (s.appearances + 4), 6) AS stable
FROM season_rows s JOIN class_means m USING (class_ord, season_start) WHERE s.groups = 1""")
def _stable(spark, d):
    history, totals = history_tables(spark, d)
    out = K.stabilize(K.season_rows(history, totals), K.class_season_means(totals))
    return out.select("player_id", "season_start", "class_ord", F.round("stable", 6).alias("stable"))


@query("J11_consecutive_seasons", _ALL + """
SELECT player_id, season_start, o_start AS older_season_start FROM neighbours
WHERE o_start IS NOT NULL""")
def _consecutive(spark, d):
    out = K.consecutive_seasons(K.season_rows(*history_tables(spark, d)))
    return out.select("player_id", "season_start", "older_season_start")


@query("A17_exclusion_counts", _ALL + """
SELECT reason, count(*) AS excluded FROM transitions WHERE reason IS NOT NULL GROUP BY 1""")
def _excluded(spark, d):
    return K.exclusion_counts(K.transitions(K.season_rows(*history_tables(spark, d))))


@query("W12_capped_weights", _ALL + """
SELECT player_id, older_start, edge, CAST(raw_weight AS BIGINT) AS raw_weight,
  CAST(least(raw_weight, 2 * quantile_disc(raw_weight, 0.5) OVER (PARTITION BY edge)) AS BIGINT)
  AS weight FROM transitions WHERE reason IS NULL""")
def _capped(spark, d):
    rows = K.transitions(K.season_rows(*history_tables(spark, d)))
    out = K.cap_weights(rows.where(F.col("reason").isNull()), ["edge"])
    return out.select("player_id", "older_start", "edge", "raw_weight", "weight")


@query("W13_weighted_median", """
SELECT l_returnflag AS flag, round(min(CASE WHEN 2 * run >= total THEN v END), 6) AS median,
  CAST(max(total) AS BIGINT) AS total_weight FROM (
  SELECT l_returnflag, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) OVER (
    PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey
    ROWS UNBOUNDED PRECEDING) AS run,
    sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
GROUP BY 1""")
def _median(spark, d):
    from .roles import table

    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), "l_extendedprice", F.col("l_quantity").cast("bigint").alias("w")
    )
    return K.weighted_median(rows, ["flag"], "l_extendedprice", "w")


_ALL_EDGES = with_ctes(SEGMENTS_SQL, SEASON_ROWS_SQL, EDGES_SQL)


@query("M3_class_calibration", _ALL_EDGES + """
SELECT cutoff, edge, observations, total_weight, round("offset", 6) AS "offset",
  observations >= 8 AS published FROM edges""")
def _edges(spark, d):
    history, totals = history_tables(spark, d)
    cutoffs = totals.select(F.col("season_start").alias("cutoff"))
    rows = K.for_cutoffs(K.transitions(K.season_rows(history, totals)), cutoffs)
    return K.calibrate_classes(rows, ["cutoff"]).select(
        "cutoff", "edge", "observations", "total_weight", F.round("offset", 6).alias("offset"),
        "published",
    )


@query("M4_convert_rating", _ALL_EDGES + """
SELECT t.player_id, t.season_start, t.class_ord, e1 IS NOT NULL OR class_ord > 1 AS calibrated,
  round(points / appearances + CASE WHEN class_ord <= 1 AND s IS NOT NULL THEN s ELSE 0 END
    - CASE WHEN class_ord = 3 AND e2 IS NOT NULL THEN e2 ELSE 0 END, 6) AS rating
FROM (SELECT totals.*, e0, e1, e2, CASE WHEN class_ord = 0 THEN e0 + e1 WHEN class_ord = 1 THEN e1
  END AS s FROM totals CROSS JOIN (SELECT * FROM edge_rows ORDER BY cutoff DESC LIMIT 1)) t""")
def _convert(spark, d):
    history, totals = history_tables(spark, d)
    cutoffs = totals.select(F.col("season_start").alias("cutoff"))
    edges = K.calibration_tables(history, totals, cutoffs)[2]
    newest = edges.agg(F.max("cutoff").alias("cutoff"))
    keyed = totals.withColumn("cutoff", newest.scalar()).join(edges, "cutoff", "left")
    target = F.lit(2)
    out = keyed.withColumn(
        "_c",
        K.convert_rating(F.col("points") / F.col("appearances"), F.col("class_ord"), target),
    )
    return out.select(
        "player_id", "season_start", "class_ord", F.col("_c.calibrated").alias("calibrated"),
        F.round("_c.rating", 6).alias("rating"),
    )


_TARGETS = """
targets AS (SELECT player_id, season_start AS cutoff, class_ord AS target_ord FROM totals)"""
_PRIORS = with_ctes(SEGMENTS_SQL, SEASON_ROWS_SQL, EDGES_SQL, _TARGETS, PRIORS_SQL)


def _targets(totals):
    return totals.select(
        "player_id", F.col("season_start").alias("cutoff"), F.col("class_ord").alias("target_ord")
    )


@query("M5_target_mean", _PRIORS + """
SELECT cutoff, target_ord, round(target_mean, 6) AS target_mean, mean_available FROM tmeans""")
def _target_mean(spark, d):
    _, totals = history_tables(spark, d)
    return K.target_mean(_targets(totals), K.class_season_means(totals)).withColumn(
        "target_mean", F.round("target_mean", 6)
    )


@query("J12_last_two_before", _PRIORS + """
SELECT player_id, cutoff, season_start, season_end, CAST(back AS INTEGER) AS back FROM last2""")
def _last_two(spark, d):
    history, totals = history_tables(spark, d)
    return K.last_two_before(K.season_rows(history, totals), _targets(totals)).select(
        "player_id", "cutoff", "season_start", "season_end", "back"
    )


@query("F5_before_season", _ALL + """
SELECT player_id, count(*) AS seasons FROM season_rows WHERE season_end <= 1999 GROUP BY 1""")
def _before(spark, d):
    rows = K.season_rows(*history_tables(spark, d))
    return (
        K.before_season(rows, F.lit(1999)).groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("seasons"))
    )


@query("M6_historical_prior", _PRIORS + """
SELECT player_id, cutoff, target_ord, round(prior, 6) AS prior, prior_seasons, class_calibrated,
  confidence FROM priors""")
def _prior(spark, d):
    history, totals = history_tables(spark, d)
    targets = _targets(totals)
    seasons, means, edges = K.calibration_tables(history, totals, targets)
    return K.historical_prior(targets, seasons, totals, means, edges).select(
        "player_id", "cutoff", "target_ord", F.round("prior", 6).alias("prior"), "prior_seasons",
        "class_calibrated", "confidence",
    )


_SINGLE = """
single AS (SELECT player_id, season_start, season_end, min(class_ord) AS class_ord,
  sum(points) / sum(appearances) AS actual FROM totals GROUP BY 1, 2, 3 HAVING count(*) = 1),
targets AS (SELECT player_id, season_start AS cutoff, class_ord AS target_ord, actual FROM single)"""
_SAMPLES = """
raws AS (SELECT l.player_id, l.cutoff, max(CASE WHEN back = 1 THEN s.actual END) AS previous,
  max(CASE WHEN back = 2 THEN s.actual END) AS before FROM last2 l JOIN single s
  ON s.player_id = l.player_id AND s.season_start = l.season_start GROUP BY 1, 2),
samples AS (SELECT t.player_id, t.cutoff AS season_start, t.target_ord AS class_ord, t.actual,
  p.prior AS hybrid, previous, 0.7::DOUBLE * previous + 0.3::DOUBLE * before AS unadjusted
  FROM targets t JOIN priors p USING (player_id, cutoff, target_ord)
  JOIN raws USING (player_id, cutoff) WHERE previous IS NOT NULL AND before IS NOT NULL)"""
_BACKTEST = with_ctes(SEGMENTS_SQL, SEASON_ROWS_SQL, EDGES_SQL, _SINGLE, PRIORS_SQL, _SAMPLES)


@query("M18_backtest", _BACKTEST + """
SELECT player_id, season_start, class_ord, round(actual, 6) AS actual, round(hybrid, 6) AS hybrid,
  round(previous, 6) AS previous, round(unadjusted, 6) AS unadjusted, false AS leak FROM samples""")
def _backtest(spark, d):
    out = K.backtest(*history_tables(spark, d))
    for c in ("actual", "hybrid", "previous", "unadjusted"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("A19_backtest_metrics", _BACKTEST + """
SELECT season_start, class_ord, count(*) AS samples, round(avg(abs(hybrid - actual)), 6) AS mae_hybrid,
  round(avg(abs(previous - actual)), 6) AS mae_previous,
  round(avg(abs(unadjusted - actual)), 6) AS mae_unadjusted, CAST(0 AS BIGINT) AS leaks
FROM samples GROUP BY GROUPING SETS ((season_start), (class_ord), ())""")
def _metrics(spark, d):
    out = K.backtest_metrics(K.backtest(*history_tables(spark, d)))
    for c in ("mae_hybrid", "mae_previous", "mae_unadjusted"):
        out = out.withColumn(c, F.round(c, 6))
    return out
