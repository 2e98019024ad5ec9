"""Queries: fixture lines, schedules, meetings, selection and archive items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matches as M
from ..operators.ordering import with_position
from .registry import query
from .roles import MATCHES_SQL, matches, table, with_ctes

_M = with_ctes(MATCHES_SQL)
_ID = ["order_id", "line_no", "part_id", "supp_id"]
_IDS = "order_id, line_no, part_id, supp_id"

# Texts with every kind of line: byes, missing and impossible times, open scores, junk.
_TEXTS_SQL = """
texts AS (
  SELECT *, CASE WHEN part_id % 50 = 0 THEN 'Spielfrei' ELSE home END AS h,
    supp_id % 5 <> 0 AS timed, part_id % 77 = 0 AS junk, part_id % 33 = 0 AS odd,
    starts_at + to_hours(12 + line_no) AS wall,
    last_day(make_date(year(starts_at), 3, 1)) AS march,
    last_day(make_date(year(starts_at), CASE WHEN year(starts_at) = 1995 THEN 9 ELSE 10 END, 1))
      AS autumn
  FROM matches
)"""


def fixture_texts(spark, d):
    """Matches with a ``line`` of text each."""
    m = matches(spark, d)
    home = F.when(F.col("part_id") % 50 == 0, "Spielfrei").otherwise(F.col("home"))
    hour = F.lpad((F.col("line_no") + 12).cast("string"), 2, "0")
    time = F.when(F.col("part_id") % 33 == 0, F.lit("25:00")).otherwise(F.concat(hour, F.lit(":00")))
    score = F.when(
        F.col("played"),
        F.concat_ws(":", F.col("home_score").cast("string"), F.col("away_score").cast("string")),
    ).otherwise(F.when(F.col("supp_id") % 2 == 0, "---").otherwise(":"))
    line = F.concat(
        F.lit("Mo. "), F.date_format("starts_at", "d"), F.lit(". "), F.date_format("starts_at", "M.yyyy"),
        F.when(F.col("supp_id") % 5 != 0, F.concat(F.lit(" "), time)).otherwise(""),
        F.lit("  "), home, F.lit("   - "), F.col("away"), F.lit("   "), score, F.lit(" "),
    )
    return m.select(
        *_ID, "league", "round",
        F.when(F.col("part_id") % 77 == 0, "kein Spielplan").otherwise(line).alias("line"),
    )


@query("X1_parse_fixtures", with_ctes(MATCHES_SQL, _TEXTS_SQL) + f"""
SELECT {_IDS}, CASE WHEN NOT junk THEN h END AS home, CASE WHEN NOT junk THEN away END AS away,
  CASE WHEN junk THEN NULL WHEN h = 'Spielfrei' THEN 'bye' WHEN NOT timed THEN 'missing_time'
    WHEN odd THEN 'invalid_time' ELSE 'game' END AS classification,
  CASE WHEN NOT junk AND h <> 'Spielfrei' AND timed AND NOT odd THEN strftime(wall - to_hours(
    CASE WHEN starts_at >= march - to_days(CAST(dayofweek(march) AS INTEGER))
      AND starts_at < autumn - to_days(CAST(dayofweek(autumn) AS INTEGER)) THEN 2 ELSE 1 END),
    '%Y-%m-%d %H:%M') END AS starts_at_utc,
  CASE WHEN junk THEN 'unreadable fixture line' END AS error
FROM texts""")
def _fixtures(spark, d):
    return M.parse_fixtures(fixture_texts(spark, d)).select(
        *_ID, "home", "away", "classification",
        F.date_format("starts_at_utc", "yyyy-MM-dd HH:mm").alias("starts_at_utc"), "error",
    )


@query("X2_parse_matches", with_ctes(MATCHES_SQL, _TEXTS_SQL) + f"""
SELECT {_IDS}, h AS home, away, home_score, away_score, played
FROM texts WHERE NOT junk AND h <> 'Spielfrei'""")
def _parse(spark, d):
    return M.parse_matches(fixture_texts(spark, d)).select(
        *_ID, "home", "away", "home_score", "away_score", "played"
    )


@query("X9_parse_cup_lines", _M + f"""
SELECT {_IDS}, strftime(starts_at, '%d.%m.%Y') || ' 20:00' AS date_text, home, away, home_score,
  away_score FROM matches WHERE played""")
def _cup(spark, d):
    return _cup_lines(spark, d)


def _cup_lines(spark, d):
    m = matches(spark, d)
    score = F.concat_ws(
        " : ", F.col("home_score").cast("string"), F.col("away_score").cast("string")
    )
    line = F.concat_ws(
        " ", F.lit("Spiel:"), F.date_format("starts_at", "dd.MM.yyyy"), F.lit("20:00"), "home",
        F.lit("-"), "away", F.when(F.col("played"), score).otherwise("---"),
    )
    return M.parse_cup_lines(m.select(*_ID, line.alias("line"))).drop("line")


@query("X9_cup_lines_of_clubs", _M + f"""
, c AS (SELECT replace(lower(n_name), '_', '') AS k FROM nation WHERE n_regionkey = 3),
own AS (SELECT DISTINCT n_name FROM nation, c WHERE k = replace(lower(n_name), '_', '')
  OR length(k) >= 6 AND contains(replace(lower(n_name), '_', ''), k)
  OR length(n_name) >= 9 AND contains(k, replace(lower(n_name), '_', '')))
SELECT {_IDS}, strftime(starts_at, '%d.%m.%Y') || ' 20:00' AS date_text, home, away, home_score,
  away_score FROM matches
WHERE played AND (home IN (SELECT n_name FROM own) OR away IN (SELECT n_name FROM own))""")
def _cup_of_clubs(spark, d):
    """Every line of the clubs of one region; the lines of all other clubs are left out."""
    clubs = table(spark, d, "nation").where("n_regionkey = 3").select(F.initcap("n_name").alias("club"))
    return M.cup_lines_of_clubs(_cup_lines(spark, d), clubs).select(
        *_ID, "date_text", "home", "away", "home_score", "away_score"
    )


@query("S2_match_lines", """
SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, md5(line) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
WHERE NOT regexp_matches(line, '^[\\s\\x{00A0}]*$')""")
def _lines(spark, d):
    texts = table(spark, d, "documents").select("doc_id", "text")
    return M.match_lines(texts).select("doc_id", "line_no", F.md5("line").alias("line"))


_SIDES_SQL = """
sides AS (
  SELECT *, home AS team, away AS opponent, true AS is_home, home_score AS own, away_score AS other
  FROM matches UNION ALL
  SELECT *, away, home, false, away_score, home_score FROM matches
)"""
_RESULT = """CASE WHEN own IS NULL THEN 'pending' WHEN own > other THEN 'Won'
  WHEN own < other THEN 'Lost' ELSE 'Draw' END AS result"""


@query("X3_team_schedule", with_ctes(MATCHES_SQL, _SIDES_SQL) + f"""
SELECT {_IDS}, team, opponent, is_home, {_RESULT} FROM sides""")
def _schedule(spark, d):
    return M.team_schedule(matches(spark, d)).select(
        *_ID, "team", "opponent", "is_home", "result"
    )


@query("U2_all_league_schedule", with_ctes(MATCHES_SQL, _SIDES_SQL) + f"""
SELECT {_IDS}, league, opponent, is_home, {_RESULT} FROM sides WHERE team = 'NATION_3'""")
def _all_leagues(spark, d):
    rows = matches(spark, d).withColumn("position", F.struct(*_ID))
    return M.all_league_schedule(rows, "Nation_3").select(
        *_ID, "league", "opponent", "is_home", "result"
    )


@query("X4_league_teams", _M + """
SELECT home AS team FROM matches UNION SELECT away FROM matches""")
def _teams(spark, d):
    return M.league_teams(matches(spark, d))


@query("F10_club_teams", """
SELECT DISTINCT p_name AS team FROM part
WHERE contains(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), 'ring')""")
def _club_teams(spark, d):
    teams = table(spark, d, "part").select(F.col("p_name").alias("team")).distinct()
    return M.club_teams(teams, F.lit("RING!"))


_PAIRS_SQL = """
pairs AS (SELECT a.n_name AS team_a, b.n_name AS team_b FROM nation a
  JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25)"""


def _pairs(spark, d):
    a = table(spark, d, "nation").select(
        F.col("n_name").alias("team_a"), ((F.col("n_nationkey") + 1) % 25).alias("k")
    )
    b = table(spark, d, "nation").select(F.col("n_name").alias("team_b"), F.col("n_nationkey").alias("k"))
    return a.join(b, "k").drop("k")


@query("A13_meeting_record", with_ctes(MATCHES_SQL, _SIDES_SQL, _PAIRS_SQL) + """
SELECT team_a, team_b, CAST(coalesce(sum(CASE WHEN own > other THEN 1 ELSE 0 END), 0) AS BIGINT)
    AS wins,
  CAST(coalesce(sum(CASE WHEN own = other THEN 1 ELSE 0 END), 0) AS BIGINT) AS draws,
  CAST(coalesce(sum(CASE WHEN own < other THEN 1 ELSE 0 END), 0) AS BIGINT) AS losses
FROM pairs LEFT JOIN sides ON team = team_a AND opponent = team_b AND played GROUP BY 1, 2""")
def _record(spark, d):
    return M.meeting_record(matches(spark, d), _pairs(spark, d))


@query("J18_meetings", with_ctes(MATCHES_SQL, _PAIRS_SQL) + f"""
SELECT {_IDS}, team_a, team_b, CASE WHEN home = team_a THEN home_score ELSE away_score END AS a_score,
  CASE WHEN home = team_a THEN away_score ELSE home_score END AS b_score
FROM matches JOIN pairs ON (home = team_a AND away = team_b) OR (home = team_b AND away = team_a)
WHERE played""")
def _meetings(spark, d):
    return M.meetings(matches(spark, d), _pairs(spark, d)).select(
        *_ID, "team_a", "team_b", "a_score", "b_score"
    )


_DATED_SQL = """
dated AS (SELECT * REPLACE (CASE WHEN part_id % 11 = 0 THEN NULL
    ELSE starts_at + to_hours(CASE WHEN supp_id % 5 <> 0 THEN line_no ELSE 0 END) END AS starts_at),
  supp_id % 5 <> 0 AS has_time FROM matches),
open AS (SELECT * FROM dated WHERE NOT played AND (starts_at IS NULL OR (has_time
    AND starts_at >= TIMESTAMP '1998-07-01 03:30:00') OR (NOT has_time
    AND starts_at >= TIMESTAMP '1998-07-01 00:00:00')))"""
_PLACE = f"""starts_at IS NULL, CAST(starts_at AS DATE) ASC NULLS LAST, has_time DESC,
  starts_at ASC NULLS LAST, {_IDS}"""


def _dated(spark, d):
    m = matches(spark, d)
    timed = F.col("supp_id") % 5 != 0
    hours = F.when(timed, F.col("line_no")).otherwise(0)
    moved = F.col("starts_at") + F.make_interval(hours=hours)
    return (
        m.withColumn("starts_at", F.when(F.col("part_id") % 11 != 0, moved))
        .withColumn("has_time", timed)
        .withColumn("position", F.struct(*_ID))
    )


_NOW = "1998-07-01 03:30:00"


def _now():
    return F.to_timestamp_ntz(F.lit(_NOW))


@query("F1_upcoming", with_ctes(MATCHES_SQL, _DATED_SQL) + f"SELECT {_IDS}, home, away FROM open")
def _upcoming(spark, d):
    return M.upcoming(_dated(spark, d), _now()).select(*_ID, "home", "away")


@query("W15_upcoming_order", with_ctes(MATCHES_SQL, _DATED_SQL) + f"""
SELECT {_IDS}, league, row_number() OVER (PARTITION BY league ORDER BY {_PLACE}) AS place
FROM open""")
def _upcoming_order(spark, d):
    rows = M.upcoming(_dated(spark, d), _now())
    return with_position(rows, ["league"], M.upcoming_order(), name="place").select(
        *_ID, "league", "place"
    )


@query("W19_next_games", with_ctes(MATCHES_SQL, _DATED_SQL) + f"""
SELECT {_IDS}, league, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY league
  ORDER BY {_PLACE}) AS INTEGER) AS place FROM open) WHERE place <= 5""")
def _next(spark, d):
    return M.next_games(M.upcoming(_dated(spark, d), _now()), ["league"], 5).select(
        *_ID, "league", "place"
    )


@query("W19_recent_games", with_ctes(MATCHES_SQL, _DATED_SQL) + f"""
SELECT {_IDS}, home, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY home
  ORDER BY starts_at DESC NULLS LAST, {_IDS}) AS INTEGER) AS place FROM dated WHERE played)
WHERE place <= 30""")
def _recent(spark, d):
    return M.recent_games(_dated(spark, d), ["home"], 30).select(*_ID, "home", "place")


@query("F9_next_matches", with_ctes(MATCHES_SQL, _DATED_SQL) + f"""
SELECT {_IDS}, league, home, away FROM dated WHERE NOT played
AND (home IN ('NATION_1', 'ANATION_1') OR away = 'NATION_1')
AND coalesce(starts_at, TIMESTAMP '9999-01-01 00:00:00') >= TIMESTAMP '1998-07-01 00:00:00'""")
def _detect(spark, d):
    return M.next_matches(_dated(spark, d), F.lit("Nation_1"), _now()).select(
        *_ID, "league", "home", "away"
    )


@query("F7_drop_withdrawn", _M + f"""
SELECT {_IDS} FROM matches m WHERE played OR NOT EXISTS (SELECT 1 FROM nation
  JOIN region ON r_regionkey = n_regionkey WHERE r_name = m.league AND n_nationkey % 4 = 0
  AND n_name IN (m.home, m.away))""")
def _withdrawn(spark, d):
    gone = (
        table(spark, d, "nation").where(F.col("n_nationkey") % 4 == 0)
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("league"), F.col("n_name").alias("team"))
    )
    return M.drop_withdrawn(matches(spark, d), gone).select(*_ID)


@query("W17_dedupe_first", _M + f"""
SELECT {_IDS} FROM (SELECT *, row_number() OVER (PARTITION BY league, home, away,
  CAST(starts_at AS DATE) ORDER BY {_IDS}) AS rn FROM matches) WHERE rn = 1 OR home = 'NATION_9'""")
def _dedupe(spark, d):
    rows = (
        matches(spark, d).withColumn("position", F.struct(*_ID))
        .withColumn("has_time", F.lit(False)).withColumn("date_text", F.lit(""))
        .withColumn("home", F.when(F.col("home") == "NATION_9", " ").otherwise(F.col("home")))
    )
    return M.dedupe_games(rows).select(*_ID)


@query("W18_dedupe_best", """
SELECT o, l, s, p FROM (SELECT *, row_number() OVER (PARTITION BY day, club
  ORDER BY two DESC, score_len DESC, o, l, p, s) AS rn FROM (
    SELECT l_orderkey AS o, l_linenumber AS l, l_suppkey AS s, l_partkey AS p,
      CAST(l_shipdate AS DATE) AS day,
      regexp_replace(lower(CASE WHEN l_suppkey % 7 = 0 THEN p_type ELSE p_name END), '[^a-z]', '', 'g')
        AS club,
      l_suppkey % 3 <> 0 AND l_suppkey % 7 <> 0 AS two,
      length(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) + 1 AS score_len
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT (l_suppkey % 3 = 0 AND l_suppkey % 7 = 0)))
WHERE rn = 1""")
def _dedupe_best(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    items = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"),
        F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"),
        F.when(F.col("l_suppkey") % 7 == 0, "-").otherwise(F.col("p_name")).alias("home"),
        F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.col("p_type")).alias("away"),
        F.col("l_quantity").cast("bigint").cast("string").alias("score_home"),
        F.lit("9").alias("score_away"),
        F.concat(F.date_format("l_shipdate", "dd.MM.yyyy"), F.lit(" 20:00")).alias("date_text"),
    )
    rows = items.withColumn("position", F.struct("o", "l", "p", "s"))
    return M.dedupe_best(rows).select("o", "l", "s", "p")


# --- archive ------------------------------------------------------------------------------------

_ROUND_NAMES = [
    "Runde 1", "Runde 2", "Runde 3", "Runde 4", "Runde 5", "Runde 6", "Achtelfinale",
    "Viertelfinale", "Halbfinale", "Spiel um Platz 3", "Finale", "Gruppenphase",
]
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in _ROUND_NAMES) + "]"
_WEIGHTS_SQL = "[1, 2, 3, 4, 5, 6, 10, 11, 12, 14, 15, 0]"


def _round_name(month):
    return F.element_at(F.array(*[F.lit(n) for n in _ROUND_NAMES]), month.cast("int"))


@query("P14_U9_split_archive", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'cup' ELSE 'league' END AS section,
  CASE WHEN l_suppkey % 3 = 0 THEN 'table' ELSE 'match' END AS kind,
  {_WEIGHTS_SQL}[month(l_shipdate)] AS round_weight FROM lineitem""")
def _split(spark, d):
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        (F.col("l_suppkey") % 2 == 0).alias("is_cup"),
        (F.col("l_suppkey") % 3 == 0).alias("is_table"),
        F.upper(_round_name(F.month("l_shipdate"))).alias("league"),
    )
    return M.split_archive(items).select(
        "order_id", "line_no", "part_id", "section", "kind", "round_weight"
    )


@query("U10_flag_incomplete", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, CASE WHEN l_linestatus = 'O' AND
  l_suppkey % 9 <> 0 THEN l_suppkey % 4 = 0 ELSE false END AS incomplete,
  CASE WHEN l_suppkey % 9 = 0 THEN 'bye' WHEN l_linestatus = 'O' AND l_suppkey % 4 = 0 THEN 'incomplete'
    ELSE CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE '9' END || ':7' END AS label FROM lineitem""")
def _incomplete(spark, d):
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.when(F.col("l_linestatus") == "O", "cup").otherwise("league").alias("section"),
        F.lit("A").alias("home"), F.lit("B").alias("away"),
        F.when(F.col("l_suppkey") % 4 != 0, F.lit("9")).alias("score_home"),
        F.lit("7").alias("score_away"), (F.col("l_suppkey") % 9 == 0).alias("is_bye"),
    )
    return M.flag_incomplete(items).select("order_id", "line_no", "part_id", "incomplete", "label")


@query("U8_fill_byes", f"""
WITH played AS (SELECT DISTINCT year(l_shipdate) AS season, l_partkey AS club,
  month(l_shipdate) AS m FROM lineitem),
reach AS (SELECT season, club, max({_WEIGHTS_SQL}[m]) AS reach FROM played GROUP BY 1, 2),
rounds AS (SELECT DISTINCT season, m, {_WEIGHTS_SQL}[m] AS w FROM played)
SELECT CAST(r.season AS INTEGER) AS season, r.club, {_NAMES_SQL}[o.m] AS round_name,
  o.w AS round_weight
FROM reach r JOIN rounds o ON o.season = r.season AND o.w > 0 AND o.w <= r.reach
WHERE NOT EXISTS (SELECT 1 FROM played p WHERE p.season = r.season AND p.club = r.club
  AND p.m = o.m)""")
def _byes(spark, d):
    played = table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.col("l_partkey").alias("club"),
        _round_name(F.month("l_shipdate")).alias("round_name"),
    )
    return M.fill_byes(played, played)


@query("U4_cup_entries", """
SELECT o_orderkey AS table_id, 'Ligapokal ' || year(o_orderdate) || '-' || (year(o_orderdate) + 1)
  AS season_label FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderpriority <> '1-URGENT'
  AND o_custkey % 4 >= 2""")
def _cup_entries(spark, d):
    cup = F.when(F.col("o_orderpriority") == "5-LOW", "B-Klasse").otherwise("Liga-Pokal Vorrunde")
    end = F.when(F.col("o_orderpriority") == "1-URGENT", "02").otherwise(
        (F.year("o_orderdate") + 1).cast("string")
    )
    tables = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("table_id"),
        F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("/"), end).alias("season"),
        cup.alias("league"), (F.col("o_custkey") % 4).alias("n_rows"),
    )
    return M.cup_entries(tables).select("table_id", "season_label")


@query("W22_round_order", f"""
SELECT name, row_number() OVER (ORDER BY n ASC NULLS LAST, name) AS place FROM (
  SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN {_NAMES_SQL}[month(l_shipdate)]
    ELSE month(l_shipdate) || '. Spieltag' END AS name,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE month(l_shipdate) END AS n FROM lineitem)""")
def _round_order(spark, d):
    month = F.month("l_shipdate")
    names = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, _round_name(month))
        .otherwise(F.concat(month.cast("string"), F.lit(". Spieltag"))).alias("name")
    ).distinct()
    return with_position(names, [], M.round_order("name"), name="place").select("name", "place")


@query("X7_parse_archive_matches", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
  strftime(l_shipdate, '%d.%m.%Y') AS date_text, 'H' || l_suppkey AS home, 'G' || l_partkey AS away,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ':3' AS score FROM lineitem""")
def _archive_matches(spark, d):
    date = F.date_format("l_shipdate", "dd.MM.yyyy")
    home = F.concat(F.lit("H"), F.col("l_suppkey").cast("string"))
    away = F.concat(F.lit("G"), F.col("l_partkey").cast("string"))
    score = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(":3"))
    kind = F.col("l_suppkey") % 3
    blank = F.lit("")
    headers = F.when(
        kind == 0, F.array(*[F.lit(h) for h in ("Runde", "Ergebnis ", "GAST", "Heim", "Datum/Zeit")])
    ).otherwise(F.array(F.lit("Info"), F.lit("x")))
    cells = (
        F.when(kind == 0, F.array(blank, score, away, home, date))
        .when(kind == 1, F.array(blank, date, F.lit("20:00"), home, away, score))
        .otherwise(F.array(date, home, away, F.concat(F.lit(" "), score)))
    )
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"), headers.alias("headers"), cells.alias("cells"),
    )
    return M.parse_archive_matches(rows)


@query("X8_coalesce_score", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
  CASE WHEN l_suppkey % 4 IN (0, 1) THEN CAST(l_quantity AS BIGINT) END AS home_score,
  CASE WHEN l_suppkey % 4 IN (0, 1) THEN CAST(7 AS BIGINT) END AS away_score FROM lineitem""")
def _coalesce(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    kind = F.col("l_suppkey") % 4
    text = F.when(kind == 3, F.lit("7")).otherwise(F.concat(F.lit(" "), q, F.lit(" : 7")))
    homes = F.when(kind == 0, q).when(kind == 2, F.lit("99"))
    aways = F.when(kind.isin(0, 2), F.lit("7"))
    score = M.coalesce_score([text], [homes], [aways])
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"), score["home"].alias("home_score"),
        score["away"].alias("away_score"),
    )
