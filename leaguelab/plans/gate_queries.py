"""Queries: publication gates and run decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import CLASSES
from ..operators import gates as G
from ..operators import standings as S
from .registry import query
from .roles import table, with_ctes



def _class(c):
    return F.element_at(F.array(*[F.lit(x) for x in CLASSES]), (c % 4 + 1).cast("int"))


def _flat(df, *metrics):
    return df.select(
        "domain", "decision", "effective_season", F.array_join("reasons", ";").alias("reasons"),
        *[F.col("metrics")[m].alias(m.replace("-", "_").lower()) for m in metrics],
    )


def _players(spark, d, copies: bool):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.concat(_class(F.col("p_partkey")), F.lit(" 2000/01")).alias("league"),
    )
    if copies:
        extra = rows.where(F.col("name").startswith("red")).unionByName(
            rows.where(F.col("name").startswith("small")).withColumn("league", F.lit("Cup"))
        )
        rows = rows.unionByName(extra)
    return rows


@query("Q1_gate_rankings", """
SELECT 'rankings' AS domain, 'publish' AS decision, '2000/01' AS effective_season, '' AS reasons,
  CAST(0 AS BIGINT) AS invalid_players, CAST(0 AS BIGINT) AS duplicates,
  count(*) FILTER (p_partkey % 4 = 0) AS bezirksliga FROM part
UNION ALL
SELECT 'rankings', 'blocked', '1999/00', 'invalid players;invalid player labels;duplicate players',
  count(*) FILTER (starts_with(p_name, 'small')), count(*) FILTER (starts_with(p_name, 'red')),
  count(*) FILTER (p_partkey % 4 = 0) FROM part
UNION ALL
SELECT 'rankings', 'retain', '1999/00', 'missing class C-Klasse', CAST(0 AS BIGINT), CAST(0 AS BIGINT),
  count(*) FILTER (p_partkey % 4 = 0) FROM part""")
def _rankings(spark, d):
    good, bad = _players(spark, d, False), _players(spark, d, True)
    tables = good.select(F.col("league").alias("category")).distinct().withColumn(
        "issue", F.lit(None).cast("string")
    )
    empty = tables.withColumn("issue", F.when(F.col("category").startswith("C-"), "empty"))
    out = None
    for players, t in ((good, tables), (bad, tables), (good, empty)):
        row = _flat(
            G.gate_rankings(players, t, F.lit("2000/2001"), F.lit("1999/00")),
            "invalid_players", "duplicates", "Bezirksliga",
        )
        out = row if out is None else out.unionByName(row)
    return out


def _league_cells(spark, d):
    nation = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(" 2000/2001")).alias("league")
    )
    wide = lambda *first: F.concat(F.array(*first), F.array_repeat(F.lit("0"), 7))
    head = nation.select("league", F.lit(0).cast("bigint").alias("row_no"), wide(F.lit("Pl"), F.lit("Team")).alias("cells"))
    rows = table(spark, d, "supplier").join(nation, F.col("k") == F.col("s_nationkey")).select(
        "league", (F.col("s_suppkey") + 1).alias("row_no"),
        F.when(F.col("s_suppkey") % 40 == 39, F.slice(wide(F.lit("1"), F.col("s_name")), 1, 8))
        .otherwise(wide(F.lit("1"), F.col("s_name"))).alias("cells"),
    )
    return head.unionByName(rows)


_TABLE_ISSUES_SQL = """
issues AS (SELECT n_name || ' 2000/2001' AS league, CASE
    WHEN bool_or(s_suppkey % 40 = 39) THEN 'inconsistent columns'
    WHEN count(s_suppkey) = 0 THEN 'table has no team' END AS table_issue
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)"""


@query("Q2_league_table_issues", with_ctes(_TABLE_ISSUES_SQL) + "SELECT * FROM issues")
def _table_issues(spark, d):
    return G.league_table_issues(_league_cells(spark, d))


def _matchday_lines(spark, d):
    nation = table(spark, d, "nation")
    last = F.when(F.col("n_nationkey") % 9 == 8, 17).otherwise(18)
    days = nation.withColumn("_no", F.explode(F.sequence(F.lit(1), last)))
    junk = (F.col("n_nationkey") % 7 == 6) & (F.col("_no") == 3)
    return days.select(
        F.concat("n_name", F.lit(" 2000/2001")).alias("league"),
        F.concat(F.col("_no").cast("string"), F.lit(". Spieltag")).alias("round_name"),
        F.when(junk, "kein Datum").when(F.col("_no") == 5, "---")
        .otherwise("Mo. 1. 9.2000 20:00 A - B ---").alias("line"),
    )


@query("Q2_matchday_issues", """
SELECT n_name || ' 2000/2001' AS league, CASE WHEN n_nationkey % 9 = 8 THEN 'number of matchdays'
  WHEN n_nationkey % 7 = 6 THEN 'line without date' END AS matchday_issue
FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def _matchdays(spark, d):
    clubs = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.concat("n_name", F.lit(" 2000/2001")).alias("league"))
    return G.matchday_issues(_matchday_lines(spark, d).join(clubs, "league", "left_semi"))


@query("Q2_gate_leagues", with_ctes(_TABLE_ISSUES_SQL) + """
SELECT 'leagues' AS domain, 'blocked' AS decision, '1999/00' AS effective_season,
  concat_ws(';', CASE WHEN count(table_issue) > 0 THEN 'bad tables' END, 'bad matchdays') AS reasons,
  count(*) AS regular_leagues, count(table_issue) AS bad_tables,
  (SELECT count(*) FROM nation WHERE n_nationkey % 9 = 8 OR n_nationkey % 7 = 6) AS bad_matchdays
FROM issues""")
def _leagues(spark, d):
    cells = _league_cells(spark, d)
    leagues = cells.select("league").distinct().unionByName(
        cells.select(F.regexp_replace("league", "2000/2001", "1998/1999").alias("league")).distinct()
    )
    out = G.gate_leagues(
        leagues, G.league_table_issues(cells), G.matchday_issues(_matchday_lines(spark, d)),
        F.lit("2000/01"), F.lit("1999/00"),
    )
    return _flat(out, "regular_leagues", "bad_tables", "bad_matchdays")


@query("Q3_gate_clubs", """
SELECT 'clubs' AS domain, 'publish' AS decision, '2000/01' AS effective_season, '' AS reasons,
  count(*) AS clubs, count(*) AS previous_clubs FROM supplier
UNION ALL
SELECT 'clubs', CASE WHEN few THEN 'blocked' ELSE 'publish' END,
  CASE WHEN few THEN '1999/00' ELSE '2000/01' END, CASE WHEN few THEN 'too few clubs' ELSE '' END, n, total
FROM (SELECT count(*) FILTER (s_acctbal < 5000) AS n, count(*) AS total, n < 0.8 * total AS few
  FROM supplier)
UNION ALL
SELECT 'clubs', 'blocked', '1999/00', 'blank name;blank number;duplicate number',
  count(*), count(*) FROM supplier""")
def _clubs(spark, d):
    clubs = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("number"), F.col("s_name").alias("name"), "s_acctbal"
    )
    broken = clubs.withColumn(
        "number", F.when(F.col("number") == "1", " ").when(F.col("number") == "2", "3").otherwise(F.col("number"))
    ).withColumn("name", F.when(F.col("number") == "5", "").otherwise(F.col("name")))
    out = None
    for candidate in (clubs, clubs.where(F.col("s_acctbal") < 5000), broken):
        row = _flat(
            G.gate_clubs(candidate, clubs, F.lit("2000/01"), F.lit("1999/00")), "clubs", "previous_clubs"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("U1_gate_seasons", """
SELECT 'archives' AS domain, 'publish' AS decision, '2001/02' AS effective_season, '' AS reasons,
  count(DISTINCT year(l_shipdate)) AS candidate_seasons, CAST(0 AS BIGINT) AS missing FROM lineitem
UNION ALL
SELECT 'archives', 'blocked', '2001/02', 'missing season', count(DISTINCT year(l_shipdate)) - 1,
  CAST(1 AS BIGINT) FROM lineitem""")
def _seasons(spark, d):
    year = F.year("l_shipdate")
    lines = table(spark, d, "lineitem")
    long = lines.select(F.concat_ws("/", year, year + 1).alias("season"))
    short = lines.select(
        F.concat_ws("-", F.lpad((year % 100).cast("string"), 2, "0"),
                    F.lpad(((year + 1) % 100).cast("string"), 2, "0")).alias("season")
    )
    less = short.where(F.col("season") != "97-98")
    out = _flat(G.gate_seasons(short, long), "candidate_seasons", "missing")
    return out.unionByName(_flat(G.gate_seasons(less, long), "candidate_seasons", "missing"))


# --- run decisions: the domains are the order priorities --------------------------------------------

_DOMAINS = {"1-URGENT": "leagues", "2-HIGH": "rankings", "3-MEDIUM": "clubs", "4-NOT SPECIFIED": "archives"}


def _domain(c):
    out = F.lit(None).cast("string")
    for key, name in _DOMAINS.items():
        out = F.when(c == key, F.lit(name)).otherwise(out)
    return out


_RESULTS_SQL = """
rows AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'leagues' WHEN '2-HIGH' THEN 'rankings'
    WHEN '3-MEDIUM' THEN 'clubs' WHEN '4-NOT SPECIFIED' THEN 'archives' END AS domain, * FROM orders),
results AS (SELECT domain, CASE WHEN domain = 'rankings' THEN 'retain' ELSE 'publish' END AS decision,
    count(*) AS n FROM rows WHERE domain IS NOT NULL GROUP BY 1, 2)"""


def _results(spark, d, failing: str | None = None):
    rows = table(spark, d, "orders").withColumn("domain", _domain(F.col("o_orderpriority"))).where(
        F.col("domain").isNotNull()
    )
    decision = F.when(F.col("domain") == "rankings", "retain").otherwise("publish")
    if failing:
        decision = F.when(F.col("domain") == failing, "blocked").otherwise(decision)
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(
        "domain", decision.alias("decision"), F.lit("2000/01").alias("effective_season"), "n"
    )


@query("Q11_run_decision", with_ctes(_RESULTS_SQL) + """
SELECT domain, decision, CASE WHEN domain = 'leagues' THEN '2000/01' ELSE '1999/00' END AS season,
  CASE WHEN domain = 'rankings' THEN 'retained' ELSE 'current' END AS state,
  CASE WHEN domain IN ('leagues', 'clubs') THEN 'now' ELSE 'then' END AS updated_at, true AS ready
FROM results""")
def _decision(spark, d):
    results = _results(spark, d)
    previous = results.select(
        "domain", F.lit("1999/00").alias("season"), F.lit("current").alias("state"),
        F.lit("then").alias("updated_at"),
    )
    changed = results.where(F.col("domain").isin("leagues", "clubs", "rankings")).select("domain")
    return G.run_decision(results, previous, changed, F.lit("now"))


@query("Q14_effective", with_ctes(_RESULTS_SQL) + """
SELECT o_orderkey, domain, CASE WHEN domain = 'rankings' THEN 'old' ELSE 'new' END AS version
FROM rows WHERE domain IS NOT NULL""")
def _effective(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", _domain(F.col("o_orderpriority")).alias("domain"))
    new, old = rows.withColumn("version", F.lit("new")), rows.withColumn("version", F.lit("old"))
    return G.effective(new, old, _results(spark, d))


@query("Q11_ranking_after_leagues", """
SELECT 'rankings' AS domain, 'blocked' AS decision, 'season differs from leagues' AS reasons
FROM (SELECT count(*) FROM part)""")
def _after(spark, d):
    tables = _players(spark, d, False).select(F.col("league").alias("category")).distinct().withColumn(
        "issue", F.lit(None).cast("string")
    )
    rankings = G.gate_rankings(_players(spark, d, False), tables, F.lit("2000/01"), F.lit("1999/00"))
    leagues = G.gate_seasons(
        *[table(spark, d, "lineitem").select(
            F.concat_ws("/", F.year("l_shipdate"), F.year("l_shipdate") + 1).alias("season")
        )] * 2
    )
    return G.ranking_after_leagues(rankings, leagues).select(
        "domain", "decision", F.array_join("reasons", ";").alias("reasons")
    )


@query("Q15_single_season", """
SELECT 'one' AS case_name, CAST(1 AS BIGINT) AS seasons, '2000-2001' AS season, true AS ok
FROM (SELECT count(*) FROM supplier)
UNION ALL SELECT 'many', count(DISTINCT year(o_orderdate)), NULL, false FROM orders""")
def _single(spark, d):
    one = table(spark, d, "supplier").select(F.concat("s_name", F.lit(" 2000-2001")).alias("league"))
    cup = table(spark, d, "supplier").select(F.lit("Ligapokal 1999-2000").alias("league"))
    year = F.year("o_orderdate")
    many = table(spark, d, "orders").select(
        F.concat(F.lit("A-Klasse "), F.concat_ws("-", year, year + 1)).alias("league")
    )
    pick = lambda name, df: G.single_season(df).select(
        F.lit(name).alias("case_name"), "seasons", "season", "ok"
    )
    return pick("one", one.unionByName(cup)).unionByName(pick("many", many))


@query("Q18_check_status", with_ctes(_RESULTS_SQL) + """
SELECT domain, reason FROM (VALUES ('clubs', 'state'), ('archives', 'season'), ('archives', 'updated_at'),
  ('5-LOW', 'unknown domain'), ('leagues', 'missing domain')) v(domain, reason)
WHERE (SELECT count(*) FROM results) > 0""")
def _status(spark, d):
    name = F.coalesce(_domain(F.col("o_orderpriority")), F.col("o_orderpriority"))
    status = table(spark, d, "orders").groupBy(name.alias("domain")).agg(
        F.max("o_orderdate").alias("updated_at")
    ).where(F.col("domain") != "leagues")
    archive = F.col("domain") == "archives"
    return G.check_status(
        status.select(
            "domain", F.when(archive, " ").otherwise("2000/01").alias("season"),
            F.when(F.col("domain") == "clubs", "broken").otherwise("current").alias("state"),
            F.when(~archive, F.col("updated_at")).alias("updated_at"),
        )
    )


# --- standings ---------------------------------------------------------------------------------------

_CELLS_SQL = """
cells AS (SELECT n_name AS league, s_suppkey AS row_no, s_name AS team, n_nationkey AS nk,
    CAST(floor(s_acctbal / 100) AS BIGINT) AS points, s_suppkey % 7 - 3 AS diff FROM supplier
  JOIN nation ON n_nationkey = s_nationkey)"""


def _standing_cells(spark, d):
    """One standings row per supplier in the league of its nation; odd nations are A, others B."""
    league = F.concat(
        F.when(F.col("n_nationkey") % 2 == 1, "A").otherwise("B"), F.lit("-Klasse Gruppe "), "n_name"
    )
    rows = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    )
    points = F.floor(F.col("s_acctbal") / 100).cast("bigint")
    note = F.when(F.col("s_suppkey") % 11 == 0, "hat ZURÜCKGEZOGEN").otherwise("")
    cell = lambda c: c.cast("string")
    return rows.select(
        league.alias("league"), F.col("n_name").alias("group"), F.col("s_suppkey").alias("row_no"),
        F.array(
            F.concat(cell(F.col("s_suppkey") % 3), F.lit(".")), F.col("s_name"), F.lit("18"), F.lit("1"),
            F.lit("2"), F.lit("3"), F.lit("9:9"), cell(F.col("s_suppkey") % 7 - 3), cell(points), note,
        ).alias("cells"),
    )


@query("X10_standings", with_ctes(_CELLS_SQL) + """
SELECT league AS "group", row_no, team, points, CAST(diff AS BIGINT) AS diff FROM cells""")
def _standings(spark, d):
    return S.standings(_standing_cells(spark, d)).select("group", "row_no", "team", "points", "diff")


@query("X11_league_leader", with_ctes(_CELLS_SQL) + """
SELECT CASE WHEN nk % 2 = 1 THEN 'A' ELSE 'B' END || '-Klasse Gruppe ' || league AS league,
  arg_min(team, row_no) AS leader FROM cells WHERE row_no % 3 = 1 GROUP BY 1""")
def _leader(spark, d):
    return S.league_leader(_standing_cells(spark, d))


@query("X12_withdrawn", with_ctes(_CELLS_SQL) + """
SELECT CASE WHEN nk % 2 = 1 THEN 'A' ELSE 'B' END || '-Klasse Gruppe ' || league AS league, team
FROM cells WHERE row_no % 11 = 0""")
def _gone(spark, d):
    return S.withdrawn(_standing_cells(spark, d))


@query("W6_class_team_rank", with_ctes(_CELLS_SQL) + """
SELECT team, CASE WHEN nk % 2 = 1 THEN 'A-Klasse' ELSE 'B-Klasse' END AS class,
  row_number() OVER (PARTITION BY nk % 2 ORDER BY points DESC, diff DESC, league, row_no) AS class_rank,
  count(*) OVER (PARTITION BY nk % 2) AS class_size FROM cells""")
def _class_rank(spark, d):
    return S.class_team_rank(S.standings(_standing_cells(spark, d))).select(
        "team", "class", "class_rank", "class_size"
    )


@query("F8_current_regular_leagues", """
SELECT DISTINCT c_mktsegment || ' 2001/2002' AS league FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def _regular(spark, d):
    year = F.year("o_orderdate")
    name = F.when(F.col("c_mktsegment") == "BUILDING", "Ligapokal").otherwise(F.col("c_mktsegment"))
    leagues = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")
    ).select(F.concat(name, F.lit(" "), F.concat_ws("/", year, year + 1)).alias("league")).distinct()
    return S.current_regular_leagues(leagues).select("league")


@query("F11_tables_mentioning", """
WITH t AS (SELECT DISTINCT n_name AS league, lower(p_name) AS cell FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN part p ON p.p_partkey = l_partkey),
c AS (SELECT DISTINCT p_name AS club, lower(p_name) AS base FROM part
  UNION SELECT DISTINCT p_name || ' II', lower(p_name) FROM part)
SELECT DISTINCT league, club FROM t JOIN c ON contains('1. ' || cell, base)""")
def _mentions(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    cells = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .select(F.col("n_name").alias("league"), F.array(F.concat(F.lit("1. "), F.upper("p_name"))).alias("cells"))
    )
    clubs = part.select(
        F.explode(F.array("p_name", F.concat("p_name", F.lit(" II")))).alias("club")
    ).distinct()
    return S.tables_mentioning(cells, clubs)


@query("Q13_two_games_per_round", """
SELECT r_name AS league, round, n_name AS team, sum(n) AS games FROM (
  SELECT n_regionkey, n_name, month(l_shipdate) AS round, count(*) AS n FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
JOIN region ON r_regionkey = n_regionkey GROUP BY ALL HAVING sum(n) > 1""")
def _two_games(spark, d):
    sides = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("r_name").alias("league"), F.month("l_shipdate").cast("bigint").alias("round"), F.col("n_name").alias("team"))
    )
    return S.two_games_per_round(sides)
