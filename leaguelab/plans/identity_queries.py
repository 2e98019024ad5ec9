"""Queries: club, team and person matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import address
from ..functions.text import club_no_key, person_key, player_key, record_key
from ..operators import identity as I
from ..operators import rankings as R
from .registry import query
from .roles import MATCHES_SQL, matches, table, with_ctes

# Suppliers are clubs; every seventh number is used twice.
_CLUBS_SQL = """
clubs AS (SELECT CAST(s_suppkey - CASE WHEN s_suppkey % 7 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS number,
  s_name AS name, s_suppkey AS position FROM supplier)"""


def _clubs(spark, d):
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        (key - F.when(key % 7 == 1, 1).otherwise(0)).cast("string").alias("number"),
        F.col("s_name").alias("name"), key.alias("position"),
    )


@query("J1_enrich_with_clubs", with_ctes(_CLUBS_SQL) + """
SELECT p_partkey AS player_id, u.name AS club_name FROM part LEFT JOIN (
  SELECT number, min(name) AS name FROM clubs GROUP BY 1 HAVING count(*) = 1) u
  ON u.number = CAST(p_partkey % 120 AS VARCHAR)""")
def _enrich(spark, d):
    players = table(spark, d, "part").select(
        F.col("p_partkey").alias("player_id"),
        F.concat(F.lit(" "), (F.col("p_partkey") % 120).cast("string")).alias("club_no"),
    )
    return I.enrich_with_clubs(players, _clubs(spark, d)).select("player_id", "club_name")


_TEAMS_SQL = """
teams AS (SELECT DISTINCT s.s_name AS club, s.s_suppkey AS no, l.l_linenumber AS slot
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""


def _team_names(spark, d):
    """Team texts 'Supplier#.. e.V. 3' of every supplier and line number; slot 1 has no number."""
    rows = table(spark, d, "lineitem").join(
        table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")
    )
    number = F.when(F.col("l_linenumber") > 1, F.concat(F.lit(" "), F.col("l_linenumber").cast("string")))
    return rows.select(
        F.concat(F.upper("s_name"), F.coalesce(number, F.lit(""))).alias("team")
    ).distinct()


@query("J2_resolve_teams", with_ctes(_TEAMS_SQL) + """
SELECT upper(club) || CASE WHEN slot > 1 THEN ' ' || slot ELSE '' END AS team,
  CASE WHEN no % 5 <> 0 THEN 'club-' || no || '-team-' || slot END AS club_team,
  no % 5 = 0 AS fallback FROM teams""")
def _resolve(spark, d):
    clubs = table(spark, d, "supplier").where(F.col("s_suppkey") % 5 != 0).select(
        F.col("s_suppkey").cast("string").alias("number"),
        F.concat(F.col("s_name"), F.lit(" e.V.")).alias("name"),
    )
    out = I.resolve_teams(_team_names(spark, d), clubs)
    known = F.col("team_id").startswith("club-")
    return out.select(
        "team", F.when(known, F.col("team_id")).alias("club_team"), (~known).alias("fallback")
    )


@query("J3_resolve_home_club", with_ctes(_TEAMS_SQL) + """
SELECT upper(club) || CASE WHEN slot > 1 THEN ' ' || slot ELSE '' END AS home,
  CASE WHEN slot = 3 AND no % 2 = 0 THEN 'x' || no ELSE CAST(no AS VARCHAR) END AS home_club
FROM teams""")
def _home(spark, d):
    base = table(spark, d, "supplier")
    clubs = base.select(
        F.col("s_suppkey").cast("string").alias("number"), F.col("s_name").alias("name")
    ).unionByName(
        base.where(F.col("s_suppkey") % 2 == 0).select(
            F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("number"),
            F.concat(F.col("s_name"), F.lit(" 3")).alias("name"),
        )
    )
    games = _team_names(spark, d).withColumnRenamed("team", "home")
    return I.resolve_home_club(games, clubs)


_BASES_SQL = """
c AS (SELECT DISTINCT p_type AS club, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS b
  FROM part),
t AS (SELECT DISTINCT p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END
    AS target FROM part),
tb AS (SELECT target, regexp_replace(target, '[^a-z0-9]', '', 'g') AS b FROM t)"""


@query("J4_club_match", with_ctes(_BASES_SQL) + """
SELECT club, target FROM c JOIN tb ON c.b = tb.b OR (length(c.b) >= 6 AND contains(tb.b, c.b))
  OR (length(tb.b) >= 8 AND contains(c.b, tb.b)) WHERE length(tb.b) >= 3""")
def _club_match(spark, d):
    part = table(spark, d, "part")
    extra = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.lower("p_type")))
    return I.club_match(
        part.select(F.col("p_type").alias("club")).distinct(),
        part.select(F.concat("p_name", F.coalesce(extra, F.lit(""))).alias("target")).distinct(),
    )


@query("J5_strict_contains_match", """
SELECT a.n_name AS name, o_orderpriority AS priority,
  n > 0 AS hit FROM (SELECT o_orderpriority, n_name, count(*) AS n FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) a""")
def _strict(spark, d):
    rows = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    )
    long = F.concat_ws(" ", "n_name", "o_orderpriority")
    numbered = F.concat_ws(" ", "n_name", (F.col("o_orderkey") % 9).cast("string"))
    hit = I.strict_contains_match(long, F.col("n_name")) & ~I.strict_contains_match(
        numbered, F.col("n_name")
    )
    return rows.groupBy(
        F.col("n_name").alias("name"), F.col("o_orderpriority").alias("priority")
    ).agg(F.bool_and(hit).alias("hit"))


@query("J6_exact_then_fuzzy", """
WITH names AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name
    ELSE split_part(p_name, ' ', 2) END AS name FROM part),
cand AS (SELECT p_name AS candidate, min(p_partkey) AS position FROM part GROUP BY 1),
k AS (SELECT name, replace(name, ' ', '') AS k FROM names),
c AS (SELECT *, replace(candidate, ' ', '') AS r FROM cand)
SELECT name, coalesce((SELECT candidate FROM c WHERE c.r = k.k),
  (SELECT arg_min(candidate, position) FROM c WHERE contains(c.r, k.k) OR contains(k.k, c.r)))
  AS candidate FROM k""")
def _exact(spark, d):
    part = table(spark, d, "part")
    names = part.select(
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name"))
        .otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")
    ).distinct()
    options = part.select(F.col("p_name").alias("candidate"), F.col("p_partkey").alias("position"))
    out = I.exact_then_fuzzy(names, options)
    return out.select(F.lower("name").alias("name"), "candidate").distinct()


@query("J7_link_history", """
WITH h AS (SELECT p_partkey AS history_id, p_name AS name FROM part WHERE p_size % 2 = 0)
SELECT c_custkey AS player_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE history_id = c_custkey)
  THEN c_custkey ELSE (SELECT min(history_id) FROM h WHERE lower(h.name) = lower(p.p_name)) END
  AS history_id FROM customer c JOIN part p ON p.p_partkey = c.c_custkey""")
def _history(spark, d):
    part = table(spark, d, "part")
    history = part.where(F.col("p_size") % 2 == 0).select(
        F.col("p_partkey").alias("history_id"), F.col("p_name").alias("name")
    )
    players = table(spark, d, "customer").join(part, F.col("p_partkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("player_id"), F.upper("p_name").alias("name")
    )
    return I.link_history(players, history).select("player_id", "history_id")


_MAP_SQL = """
clubs AS (SELECT s_suppkey AS no, lower(s_name) AS label FROM supplier),
mapping AS (SELECT CAST(no AS VARCHAR) AS club_no, label, CAST(no AS VARCHAR) AS team_id,
    false AS multi_team FROM clubs WHERE no % 3 <> 0 AND no % 10 <> 9
  UNION ALL SELECT CAST(no AS VARCHAR), label || ' ' || i, 'T' || no || '-' || i, true
  FROM clubs, (VALUES (1), (2)) v(i) WHERE no % 3 = 0 AND no % 10 <> 9)"""


def _mapping(spark, d):
    """Clubs with two teams each where the number divides by three, dropped ones at 9."""
    sup = table(spark, d, "supplier")
    no, name = F.col("s_suppkey").cast("string"), F.lower("s_name")
    clubs = sup.select(
        no.alias("club_no"), F.when(F.col("s_suppkey") % 10 != 9, name).alias("label")
    )
    slots = sup.where(F.col("s_suppkey") % 3 == 0).withColumn(
        "_i", F.explode(F.array(F.lit("1"), F.lit("2")))
    )
    teams = slots.select(
        no.alias("club_no"), F.concat_ws(" ", name, "_i").alias("label"),
        F.concat(F.lit("T"), no, F.lit("-"), F.col("_i")).alias("team_id"),
    )
    return I.team_mapping(clubs, teams)


@query("M8_team_mapping", with_ctes(_MAP_SQL) + """
SELECT *, false AS ambiguous FROM mapping""")
def _team_mapping(spark, d):
    return _mapping(spark, d).select("club_no", "label", "team_id", "multi_team", "ambiguous")


@query("J9_map_match_teams", with_ctes(_MAP_SQL) + """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, h.team_id AS home_team,
  a.team_id AS away_team, CASE WHEN h.team_id IS NULL OR a.team_id IS NULL OR h.team_id = a.team_id
    THEN 'teamMapping' END AS reason
FROM lineitem JOIN supplier s ON s.s_suppkey = l_suppkey
JOIN supplier g ON g.s_suppkey = l_partkey % 10
LEFT JOIN mapping h ON h.label = lower(s.s_name) || CASE WHEN s.s_suppkey % 3 = 0 THEN ' 1' ELSE '' END
LEFT JOIN mapping a ON a.label = lower(g.s_name)""")
def _map_matches(spark, d):
    sup = table(spark, d, "supplier")
    home = sup.select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.concat(F.lower("s_name"), F.when(F.col("s_suppkey") % 3 == 0, " 1").otherwise("")).alias(
            "home_label"
        ),
    )
    away = sup.select(F.col("s_suppkey").alias("_a"), F.lower("s_name").alias("away_label"))
    rows = table(spark, d, "lineitem").join(home, "l_suppkey").join(
        away, F.col("l_partkey") % 10 == F.col("_a")
    )
    return I.map_match_teams(rows, _mapping(spark, d)).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"), "home_team", "away_team", "reason",
    )


# --- people -----------------------------------------------------------------------------------------


def _people(spark, d):
    """One ranking row per part and return flag; the flag stands for the class."""
    rows = (
        table(spark, d, "lineitem")
        .select("l_partkey", "l_returnflag").distinct()
        .join(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), F.col("p_partkey") == F.col("l_partkey"))
    )
    league = F.when(F.col("l_returnflag") == "A", "A-Klasse").when(
        F.col("l_returnflag") == "R", "Bezirksliga"
    ).otherwise("C-Klasse")
    name = player_key(F.col("p_name"), normalized=True)
    club = F.lpad((F.col("p_size") % 10).cast("string"), 3, "0")
    pid = F.col("p_partkey").cast("string")
    return rows.select(
        F.col("p_partkey").alias("part_id"), league.alias("class"), name.alias("name_key"),
        person_key(club, pid, name).alias("person_key"), record_key(league, pid).alias("record_key"),
    )


_PEOPLE_SQL = """
people AS (SELECT DISTINCT p_partkey AS part_id, CASE l_returnflag WHEN 'A' THEN 'A-Klasse'
    WHEN 'R' THEN 'Bezirksliga' ELSE 'C-Klasse' END AS class, p_name AS name_key,
  (p_size % 10) || '|' || p_partkey || '|' || p_name AS person_key
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("P13_person_keys", with_ctes(_PEOPLE_SQL) + """
SELECT part_id, class, person_key, class || '|' || part_id AS record_key FROM people""")
def _keys(spark, d):
    return _people(spark, d).select("part_id", "class", "person_key", "record_key")


@query("P13_club_no_key", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS club_no FROM orders""")
def _club_key(spark, d):
    padded = F.concat(F.lit(" 00"), F.col("o_custkey").cast("string"), F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", club_no_key(padded).alias("club_no"))


@query("A14_group_people", with_ctes(_PEOPLE_SQL) + """
SELECT person_key, list_aggregate(list(CASE class WHEN 'Bezirksliga' THEN '0' WHEN 'A-Klasse' THEN '1'
  ELSE '3' END ORDER BY CASE class WHEN 'Bezirksliga' THEN 0 WHEN 'A-Klasse' THEN 1 ELSE 3 END),
  'string_agg', '') AS classes, count(*) AS records FROM people GROUP BY 1""")
def _group(spark, d):
    code = lambda c: F.when(c == "Bezirksliga", "0").when(c == "A-Klasse", "1").otherwise("3")
    return R.group_people(_people(spark, d)).select(
        "person_key", F.array_join(F.transform("classes", code), "").alias("classes"), "records"
    )


@query("J20_resolve_person", with_ctes(_PEOPLE_SQL) + """
, names AS (SELECT name_key, count(*) AS n FROM people GROUP BY 1)
SELECT p_partkey AS saved_id, CASE
  WHEN p_partkey % 4 = 0 THEN CASE WHEN n.n > 1 THEN 'ambiguous' WHEN n.n = 1 THEN 'resolved'
    ELSE 'missing' END
  WHEN p_partkey % 4 = 1 THEN 'invalid'
  WHEN p_partkey % 4 = 2 THEN 'missing'
  ELSE CASE WHEN k.part_id IS NULL THEN 'missing' ELSE 'resolved' END END AS status
FROM part LEFT JOIN names n ON n.name_key = p_name
LEFT JOIN (SELECT part_id FROM people WHERE class = 'A-Klasse') k ON k.part_id = p_partkey""")
def _resolve_person(spark, d):
    part = table(spark, d, "part")
    kind = F.col("p_partkey") % 4
    pid, name = F.col("p_partkey").cast("string"), F.col("p_name")
    person = person_key((F.col("p_size") % 10).cast("string"), pid, name)
    saved = part.select(
        F.col("p_partkey").alias("saved_id"),
        F.when(kind == 2, "0|0|nobody").when(kind != 0, person).alias("person_key"),
        F.when(kind != 1, record_key(F.lit("A-Klasse"), pid)).alias("record_key"),
        name.alias("name_key"),
    )
    return I.resolve_person(saved, _people(spark, d)).select("saved_id", "status")


@query("J21_resolve_feed", with_ctes(_TEAMS_SQL) + """
SELECT 'SUPPLIER ' || substr(club, 10) || CASE WHEN slot > 1 THEN ' - ' || slot ELSE '' END AS team,
  'club-' || no || '-team-' || slot AS feed FROM teams""")
def _feed(spark, d):
    clubs = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("number"), F.col("s_name").alias("name")
    )
    resolved = I.resolve_teams(_team_names(spark, d), clubs)
    index = I.feed_keys(resolved, I.club_aliases(clubs))
    wanted = resolved.select(
        F.concat(
            F.lit("SUPPLIER "), F.substring("team", 10, 9),
            F.when(F.col("slot") > 1, F.concat(F.lit(" - "), F.col("slot").cast("string"))).otherwise(""),
        ).alias("team")
    )
    return I.resolve_feed(wanted, index)


@query("U3_preview_teams", with_ctes(_CLUBS_SQL) + """
, uniq AS (SELECT number, arg_min(name, position) AS name FROM clubs GROUP BY 1),
listed AS (SELECT DISTINCT CAST(p_partkey % 120 AS VARCHAR) AS id FROM part)
SELECT l.id, coalesce(u.name, 'Firma ' || l.id) AS name FROM listed l
LEFT JOIN uniq u ON u.number = l.id
UNION ALL SELECT 'NAME:' || n_name, n_name FROM nation""")
def _preview(spark, d):
    number = (F.col("p_partkey") % 120).cast("string")
    players = table(spark, d, "part").select(
        number.alias("club_no"), F.concat(F.lit("Firma "), number).alias("company"),
        F.col("p_partkey").alias("position"),
    )
    tables = table(spark, d, "nation").select(
        F.col("n_name").alias("team"), F.col("n_nationkey").cast("bigint").alias("position")
    )
    return I.preview_teams(players, tables, _clubs(spark, d))


@query("F3_filter_clubs", """
SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE contains(lower(s_name || n_name), 'nation_1')""")
def _filter(spark, d):
    clubs = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    ).withColumn("search_text", F.lower(F.concat("s_name", "n_name")))
    return I.filter_clubs(clubs, F.lit("nation_1")).select("s_suppkey")


@query("F4_search", """
SELECT kind, key, name FROM (
  SELECT 'league' AS kind, 0 AS o, CAST(r_regionkey AS VARCHAR) AS key, CAST(r_regionkey AS BIGINT) AS k,
    r_name AS name FROM region
  UNION ALL SELECT 'club', 1, CAST(n_nationkey AS VARCHAR), n_nationkey, n_name FROM nation
  UNION ALL SELECT 'person', 2, CAST(c_custkey AS VARCHAR), c_custkey, c_name FROM customer)
WHERE contains(lower(name), 'er') ORDER BY o, k LIMIT 10""")
def _search(spark, d):
    pick = lambda t, k, n: table(spark, d, t).select(
        F.col(k).cast("bigint").alias("key"), F.col(n).alias("name")
    )
    index = I.search_index(
        pick("region", "r_regionkey", "r_name"), pick("nation", "n_nationkey", "n_name"),
        pick("customer", "c_custkey", "c_name"),
    )
    return I.search(index, " ER").select("kind", "key", "name")


@query("Q13_duplicate_fixtures", with_ctes(MATCHES_SQL) + """
SELECT league, round, season_start, home, away, count(*) AS n FROM matches
GROUP BY ALL HAVING count(*) > 1""")
def _duplicates(spark, d):
    return I.duplicate_keys(
        matches(spark, d), ["league", "round", "season_start", "home", "away"]
    )


@query("P15_address", """
SELECT s_suppkey, nullif(concat_ws(', ', CASE WHEN s_suppkey % 2 = 0 THEN s_name END,
    CASE WHEN s_suppkey % 3 = 0 THEN n_name END, CASE WHEN s_suppkey % 5 = 0 THEN r_name END), '')
    AS text,
  CASE (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END
    + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) WHEN 3 THEN 'complete' WHEN 0 THEN 'unresolved'
    ELSE 'incomplete' END AS status
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _address(spark, d):
    rows = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    when = lambda n, c, other: F.when(F.col("s_suppkey") % n == 0, F.col(c)).otherwise(other)
    a = address(when(2, "s_name", "-"), when(3, "n_name", " "), when(5, "r_name", None))
    return rows.select("s_suppkey", a["text"].alias("text"), a["status"].alias("status"))
