"""Queries: rosters, line-ups, training examples and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..operators import calibration as K
from ..operators import history as H
from ..operators import identity as I
from ..operators import outcome as O
from ..operators import roster as T
from ..operators.ordering import largest_remainder
from .rating_queries import EDGES_SQL, PRIORS_SQL, SEASON_ROWS_SQL
from .registry import query
from .roles import SEGMENTS_SQL, segment_key, segment_rounds, table, with_ctes

# --- line-up slots from order lines: four lines of an order are a line-up -------------------------

_SLOT_SQL = """
slots AS (SELECT l_orderkey AS lineup_id, l_linenumber AS slot, l_quantity / 5 AS rating,
  ['high', 'medium', 'provisional', 'very-low'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS confidence,
  ['current+history', 'current', 'historical', 'historical-fallback', 'neutral'][
    CAST(l_partkey % 5 AS INTEGER) + 1] AS evidence, l_returnflag = 'R' AS unconfirmed
  FROM lineitem),
summary AS (SELECT lineup_id, count(*) = 4 AS valid,
  CASE WHEN count(*) = 4 THEN avg(rating) ELSE 1 END AS score,
  CASE WHEN count(*) = 4 THEN max(list_position(['high', 'medium', 'provisional', 'very-low'],
    confidence)) ELSE 4 END AS worst,
  CASE WHEN count(*) = 4 THEN avg(CASE confidence WHEN 'high' THEN 0.04::DOUBLE WHEN 'medium' THEN 0.1
    WHEN 'provisional' THEN 0.2 ELSE 0.32 END + CASE WHEN evidence = 'neutral' THEN 0.18 ELSE 0 END
    + CASE WHEN unconfirmed THEN 0.04 ELSE 0 END) ELSE 0.5 END AS uncertainty
  FROM slots GROUP BY 1)"""


def _slots(spark, d):
    pick = lambda names, c: F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col(c) % len(names) + 1).cast("int")
    )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("lineup_id"), F.col("l_linenumber").alias("slot"),
        (F.col("l_quantity") / 5).alias("rating"),
        pick(["high", "medium", "provisional", "very-low"], "l_suppkey").alias("confidence"),
        pick(
            ["current+history", "current", "historical", "historical-fallback", "neutral"], "l_partkey"
        ).alias("evidence"),
        (F.col("l_returnflag") == "R").alias("unconfirmed"),
    )


@query("A21_lineup_summary", with_ctes(_SLOT_SQL) + """
SELECT lineup_id, valid, round(score, 6) AS score,
  ['high', 'medium', 'provisional', 'very-low'][worst] AS confidence,
  round(uncertainty, 6) AS uncertainty FROM summary""")
def _summary(spark, d):
    return T.lineup_summary(_slots(spark, d), ["lineup_id"]).withColumn(
        "score", F.round("score", 6)
    ).withColumn("uncertainty", F.round("uncertainty", 6))


@query("A20_weakest_confidence", with_ctes(_SLOT_SQL) + """
SELECT lineup_id, ['high', 'medium', 'provisional', 'very-low'][max(list_position(
  ['high', 'medium', 'provisional', 'very-low'], confidence))] AS confidence FROM slots GROUP BY 1""")
def _weakest(spark, d):
    from ..functions.cells import weakest_confidence

    return _slots(spark, d).groupBy("lineup_id").agg(
        weakest_confidence(F.col("confidence")).alias("confidence")
    )


@query("W21_best_four", """
SELECT l_orderkey AS team_id, count(*) AS players, round(sum(rating) / 4, 6) AS mean FROM (
  SELECT l_orderkey, l_quantity - 5 AS rating, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_quantity > 5)
WHERE rn <= 4 GROUP BY 1""")
def _best_four(spark, d):
    roster = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("team_id"), (F.col("l_quantity") - 5).alias("rating"),
        F.struct("l_linenumber", "l_partkey").alias("position"),
    )
    return T.best_four(roster, ["team_id"]).withColumn("mean", F.round("mean", 6))


@query("W20_largest_remainder", """
WITH s AS (SELECT o_orderkey AS k, o_custkey % 300 AS g, o_totalprice AS v FROM orders),
p AS (SELECT *, v * 100 / sum(v) OVER (PARTITION BY g) AS x FROM s),
w AS (SELECT *, floor(x) AS f, sum(floor(x)) OVER (PARTITION BY g) AS filled FROM p)
SELECT k, g, CAST(f + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY x - f DESC, k)
  <= 100 - filled THEN 1 ELSE 0 END AS BIGINT) AS percent FROM w""")
def _remainder(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 300).alias("g"),
        F.col("o_totalprice").alias("v"),
    )
    return largest_remainder(rows, ["g"], "v", "k").select("k", "g", "percent")


_WORDS_SQL = """
lineups AS (SELECT l_orderkey AS id, l_partkey, l_suppkey, l_quantity AS h, l_extendedprice AS e,
  l_linenumber AS n, l_returnflag AS f FROM lineitem)"""


@query("M15_pair_matrix", with_ctes(_WORDS_SQL) + """
SELECT l_partkey AS part_id, hs.i AS home_slot, vs.i AS away_slot, count(*) AS pairs,
  round(sum((h + hs.i) / (h + hs.i + 20 + vs.i)), 6) AS home_share,
  CAST(sum(floor(100 * ((h + hs.i) / (h + hs.i + 20 + vs.i)) + 0.5)) AS BIGINT) AS home_percent,
  CAST(sum(CASE WHEN f = 'R' AND hs.i = 1 OR vs.i = 4 THEN 1 ELSE 0 END) AS BIGINT) AS uncertain
FROM lineups, (VALUES (1), (2), (3), (4)) hs(i), (VALUES (1), (2), (3), (4)) vs(i) GROUP BY 1, 2, 3""")
def _pairs(spark, d):
    def slot(i, rating, confidence, evidence):
        return F.struct(
            F.lit(i).alias("slot"), rating.alias("rating"), confidence.alias("confidence"),
            F.lit(evidence).alias("evidence"), F.lit(False).alias("unconfirmed"),
        )

    q = F.col("l_quantity")
    low = F.when(F.col("l_returnflag") == "R", "very-low").otherwise("high")
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("part_id"),
        F.array(
            *[slot(i, q + i, low if i == 1 else F.lit("medium"), "current") for i in (1, 2, 3, 4)]
        ).alias("home_slots"),
        F.array(
            *[
                slot(i, F.lit(20.0) + i, F.lit("high"), "neutral" if i == 4 else "historical")
                for i in (1, 2, 3, 4)
            ]
        ).alias("away_slots"),
    )
    return O.pair_matrix(rows, ["part_id"]).groupBy("part_id", "home_slot", "away_slot").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.sum("home_share"), 6).alias("home_share"),
        F.sum("home_percent").alias("home_percent"), F.count_if("uncertain").alias("uncertain"),
    )


# --- outcome model on order lines -----------------------------------------------------------------

_EX_SQL = """
ex AS (SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS key,
  l_quantity / 10 AS h, l_partkey % 50 / 10.0::DOUBLE AS a,
  CASE WHEN floor(l_quantity / 3) > 8 THEN 'home' WHEN floor(l_quantity / 3) < 8 THEN 'away'
    ELSE 'draw' END AS outcome FROM lineitem),
g AS (SELECT row_number() OVER () - 1 AS grid_no, * FROM (SELECT s, v, p, q FROM
  (VALUES (0.5::DOUBLE), (1), (2), (4)) s(s), (VALUES (0::DOUBLE), (0.25), (0.5)) v(v),
  (VALUES (0.25::DOUBLE), (0.5), (1)) p(p), (VALUES (0.25::DOUBLE), (0.5), (1)) q(q)
  ORDER BY s, v, p, q)),
raw AS (SELECT grid_no, s, v, p, q, outcome, (h - a) / s + v AS d FROM ex, g),
e AS (SELECT *, exp(least(50, greatest(-50, d))) AS rh, exp(least(50, greatest(-50, -d))) AS ra,
  p * exp(-q * abs(d)) AS rd FROM raw),
b AS (SELECT grid_no, s, v, p, q, avg(
  (rh / (rh + rd + ra) - CASE WHEN outcome = 'home' THEN 1 ELSE 0 END) ** 2
  + (rd / (rh + rd + ra) - CASE WHEN outcome = 'draw' THEN 1 ELSE 0 END) ** 2
  + (ra / (rh + rd + ra) - CASE WHEN outcome = 'away' THEN 1 ELSE 0 END) ** 2) AS brier
  FROM e GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT * FROM b ORDER BY round(brier, 15), grid_no LIMIT 1)"""


def _examples(spark, d):
    bulls = F.floor(F.col("l_quantity") / 3)
    return table(spark, d, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        (F.col("l_quantity") / 10).alias("home_rating"),
        (F.col("l_partkey") % 50 / 10).alias("away_rating"),
        F.when(bulls > 8, "home").when(bulls < 8, "away").otherwise("draw").alias("outcome"),
    )


@query("A18_brier", with_ctes(_EX_SQL) + """
SELECT CAST(grid_no AS INTEGER) AS grid_no, round(brier, 6) AS brier FROM b""")
def _brier(spark, d):
    return O.brier(_examples(spark, d)).select(
        F.col("params.grid_no").alias("grid_no"), F.round("brier", 6).alias("brier")
    )


@query("M13_calibrate_outcome", with_ctes(_EX_SQL) + """
SELECT true AS calibrated, (SELECT count(*) FROM ex) AS examples, s AS scale, v AS home_advantage,
  p AS draw_peak, q AS draw_decay, round(brier, 6) AS brier FROM best""")
def _model(spark, d):
    return O.calibrate_outcome(_examples(spark, d)).withColumn("brier", F.round("brier", 6))


@query("M12_outcome_probs", with_ctes(_EX_SQL) + """
SELECT key, h AS home_rating, a AS away_rating, round(rh / (rh + rd + ra), 6) AS home,
  round(rd / (rh + rd + ra), 6) AS draw, round(ra / (rh + rd + ra), 6) AS away
FROM (SELECT key, h, a, exp((h - a) / 2 + 0.25) AS rh, exp(-((h - a) / 2 + 0.25)) AS ra,
  0.5 * exp(-0.5 * abs((h - a) / 2 + 0.25)) AS rd FROM ex)""")
def _probs(spark, d):
    params = F.struct(
        F.lit(2.0).alias("scale"), F.lit(0.25).alias("home_advantage"),
        F.lit(0.5).alias("draw_peak"), F.lit(0.5).alias("draw_decay"),
    )
    p = O.outcome_probs(F.col("home_rating"), F.col("away_rating"), params)
    return _examples(spark, d).select(
        "key", "home_rating", "away_rating",
        *[F.round(p[n], 6).alias(n) for n in ("home", "draw", "away")],
    )


@query("M14_forecast", with_ctes(_SLOT_SQL, _EX_SQL) + """
, m AS (SELECT o_orderkey AS match_id, o_orderkey AS hid, (o_orderkey + 1) AS aid FROM orders),
j AS (SELECT match_id, h.valid AND a.valid AS ok, h.score AS hs, a.score AS s2,
  greatest(h.worst, a.worst) AS worst, least(0.45, 0.03 + (h.uncertainty + a.uncertainty) / 2) AS w
  FROM m JOIN summary h ON h.lineup_id = hid JOIN summary a ON a.lineup_id = aid),
r AS (SELECT j.*, exp((hs - s2) / s + v) AS rh, exp(-((hs - s2) / s + v)) AS ra,
  p * exp(-q * abs((hs - s2) / s + v)) AS rd FROM j, best)
SELECT match_id, CASE WHEN ok THEN 'probability' ELSE 'relative' END AS mode,
  CASE WHEN ok THEN round(rh / (rh + rd + ra), 6) END AS home,
  CASE WHEN ok THEN round(greatest(0, rh / (rh + rd + ra) - w), 6) END AS home_low,
  CASE WHEN ok THEN round(least(1, ra / (rh + rd + ra) + w), 6) END AS away_high,
  round(hs / (hs + s2), 6) AS home_share,
  ['high', 'medium', 'provisional', 'very-low'][worst] AS confidence FROM r""")
def _forecast(spark, d):
    summaries = T.lineup_summary(_slots(spark, d), ["lineup_id"])
    matches = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderkey").alias("home_lineup"),
        (F.col("o_orderkey") + 1).alias("away_lineup"),
    )
    model = O.calibrate_outcome(_examples(spark, d))
    return O.forecast(matches, summaries, model).select(
        "match_id", "mode", F.round("home", 6).alias("home"), F.round("home_low", 6).alias("home_low"),
        F.round("away_high", 6).alias("away_high"), F.round("home_share", 6).alias("home_share"),
        "confidence",
    )


# --- training examples from the history --------------------------------------------------------------

_GAMES_SQL = """
games AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS season_start, CAST(month(l_shipdate) AS BIGINT)
    AS round, CAST(l_linenumber % 4 AS INTEGER) AS class_ord, l_suppkey % 25 AS hc,
    (l_suppkey + l_partkey) % 25 AS ac, CAST(l_quantity AS BIGINT) % 17 AS hs,
    16 - CAST(l_quantity AS BIGINT) % 17 AS s2 FROM lineitem),
uniq AS (SELECT season_start, round, class_ord, hc, ac, min(hs) AS hs, min(s2) AS s2,
    count(DISTINCT hs) > 1 AS conflict FROM games WHERE hc <> ac GROUP BY 1, 2, 3, 4, 5),
part4 AS (SELECT season_start, class_ord, round, club_no, list(player_id ORDER BY player_id) AS players
  FROM (SELECT DISTINCT r.season_start, r.class_ord, r.round, r.club_no, r.player_id
    FROM segment_rounds r JOIN history h ON h.player_id = r.player_id
      AND h.season_start = r.season_start AND h.class_ord = r.class_ord AND h.club_no = r.club_no
    WHERE r.points IS NOT NULL AND h.eligible AND NOT h.ambiguous) GROUP BY 1, 2, 3, 4
  HAVING count(*) = 4),
lined AS (SELECT u.*, h.players AS hp, a.players AS ap FROM uniq u
  LEFT JOIN part4 h ON h.season_start = u.season_start AND h.class_ord = u.class_ord
    AND h.round = u.round AND h.club_no = CAST(u.hc AS VARCHAR)
  LEFT JOIN part4 a ON a.season_start = u.season_start AND a.class_ord = u.class_ord
    AND a.round = u.round AND a.club_no = CAST(u.ac AS VARCHAR)),
reasons AS (SELECT *, CASE WHEN conflict THEN 'conflictingDuplicate' WHEN hp IS NULL OR ap IS NULL
    THEN 'participants' WHEN len(list_intersect(hp, ap)) > 0 THEN 'crossSidePlayer' END AS reason
  FROM lined),
targets AS (SELECT DISTINCT unnest(list_concat(hp, ap)) AS player_id, season_start AS cutoff,
    class_ord AS target_ord FROM reasons WHERE reason IS NULL)"""

_LINED = with_ctes(SEGMENTS_SQL, _GAMES_SQL)


def _history(spark, d):
    long = segment_rounds(spark, d, once=True)
    usable = H.usable_history(H.build_segments(long), long)
    history = cut_lineage(usable.drop("segment_id")).withColumn("segment_id", segment_key())
    return long, history, H.season_class_totals(history)


def _lined_up(spark, d, long, history):
    club = lambda c: c.cast("string")
    clubs = table(spark, d, "part").select(
        club(F.col("p_partkey") % 25).alias("club_no")
    ).distinct().withColumn("label", F.concat(F.lit("club "), F.col("club_no")))
    mapping = I.team_mapping(clubs)
    goals = F.col("l_quantity").cast("bigint") % 17
    label = lambda c: F.concat(F.lit("club "), club(c % 25))
    games = table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("season_start"), F.month("l_shipdate").cast("bigint").alias("round"),
        (F.col("l_linenumber") % 4).alias("class_ord"),
        label(F.col("l_suppkey")).alias("home_label"),
        label(F.col("l_suppkey") + F.col("l_partkey")).alias("away_label"),
        goals.alias("home_score"), (16 - goals).alias("away_score"),
    )
    unique = O.distinct_matches(I.map_match_teams(games, mapping))
    # The columns of a segment's id, without the id: eligible segments have a class, participants a club.
    segment = ["player_id", "season_start", "class_ord", "club_no"]
    usable = history.where(F.col("eligible") & ~F.col("ambiguous")).select(*segment)
    rounds = long.join(usable, segment, "left_semi").withColumn(
        "team_label", F.lit(None).cast("string")
    )
    lineups = O.full_lineups(O.match_participants(rounds, mapping))
    return O.lined_up_matches(unique, lineups)


@query("J8_J17_lined_up_matches", _LINED + """
SELECT season_start, round, class_ord, CAST(hc AS VARCHAR) AS home_club, CAST(ac AS VARCHAR) AS away_club,
  reason FROM reasons""")
def _matches(spark, d):
    long, history, _ = _history(spark, d)
    return _lined_up(spark, d, long, history).select(
        "season_start", "round", "class_ord", "home_club", "away_club", "reason"
    )


@query("M11_outcome_examples", with_ctes(SEGMENTS_SQL, _GAMES_SQL, SEASON_ROWS_SQL, EDGES_SQL, PRIORS_SQL) + """
SELECT r.season_start, r.round, r.class_ord, CAST(hc AS VARCHAR) AS home_club,
  CASE WHEN hs > s2 THEN 'home' WHEN hs < s2 THEN 'away' ELSE 'draw' END AS outcome,
  round(avg(CASE WHEN list_contains(hp, p.player_id) THEN prior END), 6) AS home_rating,
  round(avg(CASE WHEN list_contains(ap, p.player_id) THEN prior END), 6) AS away_rating
FROM reasons r JOIN priors p ON p.cutoff = r.season_start AND p.target_ord = r.class_ord
  AND (list_contains(hp, p.player_id) OR list_contains(ap, p.player_id))
WHERE reason IS NULL GROUP BY r.season_start, r.round, r.class_ord, hc, ac, hs, s2""")
def _outcome_examples(spark, d):
    long, history, totals = _history(spark, d)
    matches = cut_lineage(_lined_up(spark, d, long, history))
    targets = O.example_targets(matches)
    seasons = K.season_rows(history, totals)
    means = K.class_season_means(totals)
    # Calibrate on every season with data, like the targets.
    cutoffs = totals.select(F.col("season_start").alias("cutoff"))
    edges = K.edge_row(K.calibrate_classes(K.for_cutoffs(K.transitions(seasons), cutoffs), ["cutoff"]), ["cutoff"])
    priors = K.historical_prior(targets, seasons, totals, means, edges)
    return O.outcome_examples(matches, priors).select(
        "season_start", "round", "class_ord",
        F.split_part(F.split_part("key", F.lit("|"), F.lit(4)), F.lit(":"), F.lit(1)).alias("home_club"),
        "outcome", F.round("home_rating", 6).alias("home_rating"),
        F.round("away_rating", 6).alias("away_rating"),
    )


# --- rosters of the season 2001 -------------------------------------------------------------------------

_ROSTER_SQL = """
cur AS (SELECT l_partkey AS player_id, CAST(l_partkey % 25 AS VARCHAR) AS club_no,
    CAST((p_size + 1) % 5 AS INTEGER) AS class_ord, CAST(sum(l_quantity) AS BIGINT) AS points,
    count(*) AS appearances FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE year(l_shipdate) = 2001 GROUP BY 1, 2, 3),
past AS (SELECT *, max(last_round) OVER (PARTITION BY player_id, season_start) AS m FROM history
  WHERE season_start IN (1999, 2000) AND NOT ambiguous),
cand AS (SELECT DISTINCT player_id, season_start, club_no, class_ord FROM (
    SELECT *, min(club_no) OVER w AS lo, max(club_no) OVER w AS hi FROM past
    WHERE last_round = m AND m >= 0 WINDOW w AS (PARTITION BY player_id, season_start))
  WHERE lo = hi AND class_ord <= 3),
targets AS (SELECT player_id, 2001 AS cutoff, class_ord AS target_ord FROM cur WHERE class_ord <= 3
  UNION SELECT player_id, 2001, class_ord FROM cand)"""
_MADE_SQL = """
roster1 AS (
  SELECT c.club_no, c.class_ord, c.player_id,
    CASE WHEN c.appearances > 0 THEN (c.points + 4 * p.prior) / (c.appearances + 4) ELSE p.prior END
      AS rating,
    CASE WHEN p.prior_seasons > 0 THEN 'current+history' ELSE 'current' END AS evidence,
    CASE WHEN p.prior_seasons > 0 AND NOT p.class_calibrated THEN 'very-low'
      WHEN c.appearances >= 8 THEN 'high' WHEN p.prior_seasons > 0 THEN 'medium'
      ELSE 'provisional' END AS confidence
  FROM cur c JOIN priors p ON p.player_id = c.player_id AND p.target_ord = c.class_ord
  UNION ALL
  SELECT c.club_no, c.class_ord, c.player_id, p.prior, 'historical',
    CASE WHEN p.confidence = 'very-low' THEN 'very-low' ELSE 'provisional' END
  FROM cand c JOIN priors p ON p.player_id = c.player_id AND p.target_ord = c.class_ord
  WHERE c.season_start = 2000 AND p.prior_seasons > 0
    AND c.player_id NOT IN (SELECT player_id FROM cur)),
older AS (SELECT c.club_no, c.class_ord, c.player_id, p.prior AS rating, row_number() OVER (
    PARTITION BY c.club_no, c.class_ord ORDER BY p.prior DESC, c.player_id) AS place
  FROM cand c JOIN priors p ON p.player_id = c.player_id AND p.target_ord = c.class_ord
  WHERE c.season_start = 1999 AND p.prior_seasons > 0
    AND c.player_id NOT IN (SELECT player_id FROM cur)
    AND c.player_id NOT IN (SELECT player_id FROM history WHERE season_start = 2000)),
roster AS (SELECT * FROM roster1 UNION ALL
  SELECT o.club_no, o.class_ord, o.player_id, o.rating, 'historical-fallback', 'very-low' FROM older o
  LEFT JOIN (SELECT club_no, class_ord, count(*) AS n FROM roster1 GROUP BY 1, 2) s
    USING (club_no, class_ord) WHERE o.place <= 4 - coalesce(s.n, 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY club_no, class_ord ORDER BY list_position(
    ['current+history', 'current', 'historical', 'historical-fallback'], evidence), rating DESC,
    player_id) AS slot FROM roster)"""
_ROSTER = with_ctes(SEGMENTS_SQL, SEASON_ROWS_SQL, EDGES_SQL, _ROSTER_SQL, PRIORS_SQL, _MADE_SQL)


def _roster_tables(spark, d):
    """Teams, current players, candidates, history, priors and class means for 2001."""
    _, history, totals = _history(spark, d)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("player_id"), "p_size", "p_name")
    # Rows of all seasons: the operator tells the current ones.
    played = table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("player_id"), F.year("l_shipdate").alias("_year")
    ).agg(F.sum("l_quantity").cast("bigint").alias("points"), F.count(F.lit(1)).alias("appearances"))
    season = F.concat(F.col("_year"), F.lit("/"), F.lpad(((F.col("_year") + 1) % 100).cast("string"), 2, "0"))
    labels = F.array(*[F.lit(x) for x in [*K.CLASSES, "Mix"]])
    sources = played.join(part, "player_id").select(
        "player_id", F.col("p_name").alias("name"), F.lower("p_name").alias("name_key"),
        (F.col("player_id") % 25).cast("string").alias("club_no"),
        F.concat(
            F.element_at(labels, ((F.col("p_size") + 1) % 5 + 1).cast("int")), F.lit(" "), season
        ).alias("league"),
        season.alias("season"), F.lit(None).cast("string").alias("team_label"),
        "points", "appearances",
    )
    return history, totals, sources


def _teams(spark, d):
    clubs = table(spark, d, "part").select((F.col("p_partkey") % 25).cast("string").alias("club_no")).distinct()
    return clubs.withColumn("target_ord", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
        F.concat_ws(":", "club_no", "target_ord").alias("team_id"), "club_no",
        F.lit(None).cast("string").alias("label"), F.lit(False).alias("multi_team"),
        F.lit(2001).alias("cutoff"), "target_ord",
    )


def _current(sources):
    from ..functions.classes import class_ordinal

    # Mixed labels are no class; their rows keep a NULL class and fit no team.
    fixed = sources.withColumn(
        "league", F.when(F.col("league").startswith("Mix"), "Mix").otherwise(F.col("league"))
    )
    out = T.current_players(fixed, None, "2001/02", normalized=True)
    return out.withColumn("class_ord", class_ordinal(F.col("class")))


def _roster(spark, d):
    history, totals, sources = _roster_tables(spark, d)
    teams, current = _teams(spark, d), cut_lineage(_current(sources))
    candidates = cut_lineage(T.historical_candidates(teams, history))
    targets = T.roster_targets(teams, current, candidates)
    seasons = K.season_rows(history, totals)
    cutoffs = teams.select("cutoff")
    edges = K.edge_row(K.calibrate_classes(K.for_cutoffs(K.transitions(seasons), cutoffs), ["cutoff"]), ["cutoff"])
    means = K.class_season_means(totals)
    priors = cut_lineage(K.historical_prior(targets, seasons, totals, means, edges))
    return teams, T.team_roster(teams, current, candidates, history, priors), means


@query("M9_team_roster", _ROSTER + """
SELECT club_no || ':' || class_ord AS team_id, player_id, round(rating, 6) AS rating, evidence,
  confidence FROM roster""")
def _team_roster(spark, d):
    return _roster(spark, d)[1].select(
        "team_id", "player_id", F.round("rating", 6).alias("rating"), "evidence", "confidence"
    )


@query("W14_roster_order", _ROSTER + """
SELECT club_no || ':' || class_ord AS team_id, player_id, slot AS place FROM placed""")
def _roster_place(spark, d):
    from ..operators.ordering import with_position

    roster = _roster(spark, d)[1]
    return with_position(roster, ["team_id"], T.roster_order(), name="place").select(
        "team_id", "player_id", "place"
    )


@query("M10_complete_lineup", _ROSTER + """
, teams AS (SELECT DISTINCT CAST(p_partkey % 25 AS VARCHAR) AS club_no, i AS class_ord
  FROM part, (VALUES (0), (1), (2), (3)) v(i)),
means AS (SELECT class_ord, arg_max(mean, season_end) AS mean FROM class_means WHERE season_end <= 2001
  GROUP BY 1),
full4 AS (SELECT t.club_no, t.class_ord, i AS slot, coalesce(p.rating, m.mean, 1) AS rating,
    coalesce(p.evidence, 'neutral') AS evidence, coalesce(p.confidence, 'very-low') AS confidence
  FROM teams t CROSS JOIN (VALUES (1), (2), (3), (4)) v(i)
  LEFT JOIN placed p ON p.club_no = t.club_no AND p.class_ord = t.class_ord AND p.slot = i
  LEFT JOIN means m ON m.class_ord = t.class_ord)
SELECT club_no || ':' || class_ord AS team_id, CAST(slot AS INTEGER) AS slot, round(rating, 6) AS rating,
  evidence, CASE WHEN sum(CASE WHEN evidence = 'neutral' THEN 1 ELSE 0 END) OVER w >= 2 THEN 'very-low'
    ELSE ['high', 'medium', 'provisional', 'very-low'][max(list_position(
      ['high', 'medium', 'provisional', 'very-low'], confidence)) OVER w] END AS team_confidence
FROM full4 WINDOW w AS (PARTITION BY club_no, class_ord)""")
def _complete(spark, d):
    teams, roster, means = _roster(spark, d)
    class_means = K.target_mean(teams, means).select(
        "cutoff", "target_ord", F.when(F.col("mean_available"), F.col("target_mean")).alias("class_mean")
    )
    full = T.complete_lineup(
        roster, teams.select("team_id", "cutoff", "target_ord").join(class_means, ["cutoff", "target_ord"])
    )
    return full.select("team_id", F.explode("slots").alias("s"), "team_confidence").select(
        "team_id", F.col("s.slot").alias("slot"), F.round("s.rating", 6).alias("rating"),
        F.col("s.evidence").alias("evidence"), "team_confidence",
    )


@query("J13_J14_roster_vetoes", _ROSTER + """
SELECT player_id, season_start, class_ord FROM cand
WHERE player_id NOT IN (SELECT player_id FROM cur)
  AND (season_start = 2000 OR player_id NOT IN (SELECT player_id FROM history WHERE season_start = 2000))""")
def _vetoes(spark, d):
    history, _, sources = _roster_tables(spark, d)
    teams = _teams(spark, d)
    free = T.veto_roster(T.historical_candidates(teams, history), _current(sources))
    newest = history.where(F.col("season_start") == 2000).select("player_id", F.lit(2001).alias("cutoff"))
    kept = free.where(F.col("age") == 1).unionByName(
        T.absent_from_season(free.where(F.col("age") == 2), newest).select(*free.columns)
    )
    return kept.select(
        "player_id", (F.lit(2001) - F.col("age")).alias("season_start"),
        F.col("target_ord").alias("class_ord"),
    ).distinct()


@query("M7_current_players", """
SELECT o_custkey AS player_id, CASE WHEN bool_or(o_orderpriority = '5-LOW') THEN 'ambiguous'
  WHEN count(DISTINCT o_totalprice) FILTER (year(o_orderdate) = 1998) > 1 THEN 'ambiguous'
  WHEN count(*) FILTER (year(o_orderdate) = 1998) = 0 THEN 'irrelevant' ELSE 'usable' END AS status
FROM orders GROUP BY 1""")
def _current_rows(spark, d):
    year = F.year("o_orderdate")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("player_id"), F.lit("Ann").alias("name"), F.lit("ann").alias("name_key"),
        F.lit("7").alias("club_no"), F.concat(F.lit("A-Klasse "), year.cast("string"), F.lit("/"),
            F.lpad(((year + 1) % 100).cast("string"), 2, "0")).alias("league"),
        F.when(F.col("o_orderpriority") == "5-LOW", "nonsense").alias("season"),
        F.lit(None).cast("string").alias("team_label"), F.col("o_totalprice").alias("points"),
        F.lit(1).alias("appearances"),
    )
    return T.current_players(rows, None, "1998/99", normalized=True).select("player_id", "status")
