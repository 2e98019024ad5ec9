"""Queries: the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as X
from ..functions import classes as C
from ..functions import dates as T
from ..functions import seasons as S
from ..functions import text as N
from ..functions.fingerprint import fingerprint
from ..functions.titles import title_identity
from .registry import query
from .roles import table

_LINE = "l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s"


def _lines(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_quantity", "l_returnflag",
        "l_shipdate", F.year("l_shipdate").alias("y"),
    )


_ID = ["o", "n", "p", "s"]


def _short(c):
    return F.lpad((c % 100).cast("string"), 2, "0")


@query("P1_canonical_season", f"""
SELECT {_LINE}, CASE WHEN l_suppkey % 5 < 4 THEN CAST(year(l_shipdate) AS INTEGER) END AS start,
  CASE WHEN l_suppkey % 5 < 4 THEN CAST(year(l_shipdate) + CASE WHEN l_suppkey % 5 = 3 THEN 2 ELSE 1 END
    AS INTEGER) END AS "end",
  CASE WHEN l_suppkey % 5 < 4 THEN year(l_shipdate) || '/' || right(CAST(year(l_shipdate)
    + CASE WHEN l_suppkey % 5 = 3 THEN 2 ELSE 1 END AS VARCHAR), 2) END AS key FROM lineitem""")
def _season(spark, d):
    y = F.col("y")
    text = (
        F.when(F.col("s") % 5 == 0, F.concat(_short(y), F.lit("/"), _short(y + 1)))
        .when(F.col("s") % 5 == 1, F.concat(F.lit(" "), y.cast("string"), F.lit(" - "), (y + 1).cast("string")))
        .when(F.col("s") % 5 == 2, F.concat(y.cast("string"), F.lit("/"), _short(y + 1)))
        .when(F.col("s") % 5 == 3, F.concat_ws("/", y, y + 2))
        .otherwise(F.concat_ws("/", y, y + 3))
    )
    return _lines(spark, d).withColumn("k", S.canonical_season(text)).select(
        *_ID, F.col("k.start").alias("start"), F.col("k.end").alias("end"), F.col("k.key").alias("key")
    )


@query("P1b_strict_season", f"""
SELECT {_LINE}, CASE WHEN l_suppkey % 3 = 0 THEN year(l_shipdate) || '/'
  || right(CAST(year(l_shipdate) + 1 AS VARCHAR), 2) END AS strict_key,
  CASE WHEN l_suppkey % 3 < 2 THEN year(l_shipdate) || '/' || right(CAST(year(l_shipdate)
    + 1 AS VARCHAR), 2) END AS trailing FROM lineitem""")
def _strict(spark, d):
    y = F.col("y")
    kind = F.col("s") % 3
    text = F.when(kind == 0, F.concat(y.cast("string"), F.lit("/"), _short(y + 1))).when(
        kind == 1, F.concat(_short(y), F.lit("/"), _short(y + 1))
    ).otherwise(F.concat_ws("/", y, y + 2))
    label = F.concat(
        F.lit("A-Klasse Gruppe 1 - "),
        F.when(kind == 2, F.concat_ws("-", y, y + 2)).otherwise(F.concat_ws("-", y, y + 1)),
    )
    return _lines(spark, d).select(
        *_ID, S.canonical_season(text, strict=True)["key"].alias("strict_key"),
        S.trailing_season(label)["key"].alias("trailing"),
    )


@query("P1c_season_in_label", f"""
SELECT {_LINE}, CASE WHEN l_suppkey % 2 = 0 THEN year(l_shipdate) || '/' || right(CAST(
  year(l_shipdate) + 1 AS VARCHAR), 2) END AS key FROM lineitem""")
def _in_label(spark, d):
    one = F.concat(F.lit("B-Klasse Saison "), F.concat_ws("/", F.col("y"), F.col("y") + 1))
    two = F.concat(one, F.lit(" und "), F.concat_ws("-", F.col("y"), F.col("y") + 1))
    label = F.when(F.col("s") % 2 == 0, one).otherwise(two)
    return _lines(spark, d).select(*_ID, S.season_in_label(label)["key"].alias("key"))


_LABELS = [
    "Bezirksliga", "A-Klasse Gruppe 2", "b klasse", "C–Klasse / Saison 24/25", "A-Klasse Gruppe Pokal",
    "Ligapokal Runde 1", "BEZIRKSOBERLIGA Nord", "Tabelle der c-klasse", "A-Klasse 2000/2001",
    "B-Klasse 24/25",
]
_ANSWERS = {
    "strict": ["Bezirksliga", "A-Klasse", "B-Klasse", "C-Klasse", None, None, None, None, "A-Klasse", "B-Klasse"],
    "loose": ["Bezirksliga", "A-Klasse", "B-Klasse", None, "A-Klasse", None, None, "C-Klasse", "A-Klasse", "B-Klasse"],
    "category": ["Bezirksliga|", None, None, None, None, None, None, None, "A-Klasse|2000/01", None],
    "tier": ["BZ", "A", "B", "", "A", "", "BOL", "C", "A", "B"],
}


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query("P2_league_classes", "SELECT " + ", ".join([
    "p_partkey AS k",
    *[f"{_sql_list(v)}[p_partkey % 10 + 1] AS {name}" for name, v in _ANSWERS.items()],
    "[0, 1, 2, 3, NULL, NULL, NULL, NULL, 1, 2][p_partkey % 10 + 1] AS ordinal",
    "[4, 3, 0, 0, 3, 0, 4, 1, 3, 2][p_partkey % 10 + 1] AS strength",
]) + " FROM part")
def _classes(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), label.alias("t"))
    strict = C.league_class(F.col("t"))
    out = rows.withColumn("strict", strict).withColumn("_c", C.required_category(F.col("t")))
    category = F.when(
        F.col("_c").isNotNull(),
        F.concat(F.col("_c.class"), F.lit("|"), F.coalesce(F.col("_c.season"), F.lit(""))),
    )
    return out.select(
        "k", "strict", C.league_class_loose(F.col("t")).alias("loose"), category.alias("category"),
        C.tier_label(F.col("t")).alias("tier"), C.class_ordinal(F.col("strict")).alias("ordinal"),
        C.class_strength(F.col("t")).alias("strength"),
    )


@query("P3_player_names", """
SELECT c_custkey, c_name || ' Jr.' AS shown, lower(c_name) || ' jr.' AS key,
  'jr. ' || lower(c_name) AS swapped FROM customer""")
def _names(spark, d):
    wide = F.concat(F.lit(" "), F.col("c_name"), F.lit("  Ｊｒ. "))
    rows = table(spark, d, "customer")
    return rows.select(
        "c_custkey", N.display_name(wide).alias("shown"), N.player_key(wide).alias("key"),
        F.lower(N.last_first_swapped(F.concat(F.col("c_name"), F.lit(" ,Jr. ")))).alias("swapped"),
    )


@query("P4_team_keys_of_documents", """
SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ',
  'g'))) AS key FROM documents""")
def _team_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(N.team_key(F.col("text"))).alias("key"))


@query("P4b_P4d_team_names", """
SELECT s_suppkey, 'supplier' || substr(s_name, 10) || ' ev 2' AS schedule_key,
  'supplier ' || substr(s_name, 10) || ' 2' AS alias, s_name || ' e.V.' AS base,
  lower(s_name) || ' é' AS label, s_suppkey % 2 = 0 AS hidden, 'uber supplier ' || substr(s_name, 10) AS search
FROM supplier""")
def _team_names(spark, d):
    name = F.col("s_name")
    full = F.concat(name, F.lit(" e.V. 2"))
    suffix = F.element_at(
        F.array(F.lit(" Team 3"), F.lit(" IV."), F.lit(" 12")), (F.col("s_suppkey") % 3 + 1).cast("int")
    )
    tricky = F.when(F.col("s_suppkey") % 2 == 0, F.concat(name, F.lit("​"))).otherwise(name)
    return table(spark, d, "supplier").select(
        "s_suppkey", N.schedule_team_key(full).alias("schedule_key"), N.club_alias(full).alias("alias"),
        N.club_base_name(F.concat(name, F.lit(" e.V."), suffix)).alias("base"),
        N.exact_team_label(F.concat(name, F.lit("  é"))).alias("label"),
        N.exact_team_label(tricky).isNull().alias("hidden"),
        N.search_key(F.concat(F.lit("Über "), name)).alias("search"),
    )


_BYES = ["Spielfrei!", "DC Frei", "kein Gegner", "bye 2", "n.n.", "TBD", "Bayern", "", "keiner Gegner", "Offen"]


@query("P5_is_bye", """
SELECT p_partkey, [true, false, true, true, true, true, false, true, true, true][p_partkey % 10 + 1] AS bye,
  [true, false, false, false, false, false, false, false, false, false][p_partkey % 10 + 1] AS bye_key
FROM part""")
def _byes(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in _BYES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", N.is_bye(name).alias("bye"), N.is_bye_key(N.team_key(name)).alias("bye_key")
    )


@query("P6_P7_cells", f"""
SELECT {_LINE}, CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_quantity AS BIGINT) END AS points,
  CASE WHEN l_suppkey % 4 = 1 THEN 'Vw' END AS marker, l_suppkey % 4 = 2 AS error,
  CASE WHEN l_suppkey % 4 < 3 THEN CAST(l_quantity AS BIGINT) END AS loose,
  CASE WHEN l_suppkey % 4 = 0 THEN '0' || l_suppkey END AS club_no, l_suppkey % 4 = 1 AS club_marker,
  l_suppkey % 4 = 2 AS club_error FROM lineitem""")
def _cells(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    kind = F.col("s") % 4
    cell = F.when(kind == 0, F.concat(F.lit(" "), q)).when(kind == 1, "Vw").when(
        kind == 2, F.concat(q, F.lit("?"))
    )
    lead = F.when(kind < 3, F.concat(F.lit(" "), q, F.lit("*"))).otherwise("&nbsp;")
    club = F.when(kind == 0, F.concat(F.lit("0"), F.col("s").cast("string"))).when(kind == 1, "VW").when(
        kind == 2, "12b"
    )
    rows = _lines(spark, d).withColumn("r", X.round_value(cell)).withColumn("a", X.affiliation(club))
    return rows.select(
        *_ID, "r.points", F.when(F.col("r.marker") != "", F.col("r.marker")).alias("marker"), "r.error",
        X.round_value_loose(lead).alias("loose"), "a.club_no", F.col("a.marker").isNotNull().alias("club_marker"),
        F.col("a.error").alias("club_error"),
    )


@query("P8_dates", f"""
SELECT {_LINE}, CASE WHEN l_suppkey % 4 < 3 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day,
  CASE WHEN l_suppkey % 4 < 3 THEN l_suppkey % 4 = 0 END AS has_time,
  strftime(l_shipdate, '%Y-%m-%d') || ' 20:15' AS iso FROM lineitem""")
def _dates(spark, d):
    kind = F.col("s") % 4
    day = lambda f: F.date_format("l_shipdate", f)
    text = (
        F.when(kind == 0, F.concat(F.lit("Mo. "), day("d. M.yyyy"), F.lit(" 19:30 Heim")))
        .when(kind == 1, F.concat(F.lit("am "), day("dd.MM.yyyy")))
        .when(kind == 2, day("d.M.yyyy"))
        .otherwise("31.02.2001 20:00")
    )
    iso = T.iso_date(F.concat(day("yyyy-MM-dd"), F.lit("T20:15:00+02:00")))
    rows = _lines(spark, d).withColumn("g", T.german_date(text)).withColumn("i", iso)
    return rows.select(
        *_ID, F.date_format("g.day", "yyyy-MM-dd").alias("day"), F.col("g.has_time").alias("has_time"),
        F.date_format("i.ts", "yyyy-MM-dd HH:mm").alias("iso"),
    )


@query("P9_berlin_to_utc", f"""
WITH t AS (SELECT *, last_day(make_date(year(l_shipdate), 3, 1)) AS a, last_day(make_date(
    year(l_shipdate), CASE WHEN year(l_shipdate) = 1995 THEN 9 ELSE 10 END, 1)) AS b FROM lineitem),
u AS (SELECT *, a - CAST(dayofweek(a) AS INTEGER) AS spring, b - CAST(dayofweek(b) AS INTEGER) AS autumn
  FROM t)
SELECT {_LINE}, CASE WHEN CAST(l_shipdate AS DATE) NOT IN (spring, autumn) THEN strftime(l_shipdate
    + INTERVAL 150 MINUTE - to_hours(CASE WHEN l_shipdate > spring AND l_shipdate < autumn THEN 2 ELSE 1 END),
    '%Y-%m-%d %H:%M') END AS strict,
  CASE WHEN CAST(l_shipdate AS DATE) <> spring THEN strftime(l_shipdate + INTERVAL 150 MINUTE
    - to_hours(CASE WHEN l_shipdate > spring AND l_shipdate <= autumn THEN 2 ELSE 1 END),
    '%Y-%m-%d %H:%M') END AS lenient FROM u""")
def _utc(spark, d):
    wall = F.col("l_shipdate") + F.expr("INTERVAL '150' MINUTE")
    show = lambda strict: F.date_format(T.berlin_to_utc(wall, strict), "yyyy-MM-dd HH:mm")
    return _lines(spark, d).select(*_ID, show(True).alias("strict"), show(False).alias("lenient"))


@query("P10_round_number", f"""
SELECT {_LINE}, CASE WHEN l_suppkey % 4 < 3 THEN CAST(month(l_shipdate) AS BIGINT) END AS round
FROM lineitem""")
def _round(spark, d):
    m = F.month("l_shipdate").cast("string")
    kind = F.col("s") % 4
    text = F.when(kind == 0, m).when(kind == 1, F.concat(F.lit("Runde "), m)).when(
        kind == 2, F.concat(m, F.lit(". Spieltag"))
    ).otherwise("Finale")
    return _lines(spark, d).select(*_ID, X.round_number(text).alias("round"))


@query("P11_title_identity", f"""
SELECT {_LINE}, year(l_shipdate) || '/' || right(CAST(year(l_shipdate) + 1 AS VARCHAR), 2) AS season,
  ['a klasse gruppe 3', 'ligapokal', 'bezirksliga 1980 81', 'freundschaft'][l_suppkey % 4 + 1] AS title,
  ['a-klasse', 'ligapokal', 'bezirksliga', NULL][l_suppkey % 4 + 1] AS family,
  l_suppkey % 4 = 0 AS "partition" FROM lineitem""")
def _titles(spark, d):
    y = F.col("y")
    own = F.concat_ws("/", y, y + 1)
    kind = F.col("s") % 4
    title = (
        F.when(kind == 0, F.concat(F.lit("Mannschaftsmeisterschaft A-Klasse Gruppe 3 "), own))
        .when(kind == 1, F.concat(F.lit("LIGAPOKAL am 15.03.2001 ("), _short(y), F.lit("-"), _short(y + 1), F.lit(")")))
        .when(kind == 2, F.lit("Bezirksliga 1980/81"))
        .otherwise("Freundschaft_MM")
    )
    rows = _lines(spark, d).withColumn("t", title_identity(own, title))
    return rows.select(*_ID, "t.season", "t.title", "t.family", "t.partition")


@query("P12_fingerprint", """
SELECT o_orderkey, sha256('["' || o_orderkey || '",' || CASE WHEN o_orderstatus = 'P' THEN 'null'
  ELSE '"' || o_orderstatus || '"' END || ']') AS print FROM orders""")
def _fingerprint(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", fingerprint("o_orderkey", status).alias("print"))


@query("P16_P19_guards", """
SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_totalprice / 300 <= 1000
    THEN round(o_totalprice / 300, 6) END AS rating,
  CASE WHEN o_custkey % 3 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'current'
    WHEN o_orderstatus = 'O' THEN 'retained' ELSE 'unknown' END AS fresh,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS first,
  CASE WHEN o_orderstatus = 'F' THEN 'B' ELSE o_orderstatus || ',B' END AS changes FROM orders""")
def _guards(spark, d):
    k = F.col("o_custkey")
    value = F.when(k % 8 == 0, float("nan")).when(k % 8 == 4, -1.0).otherwise(F.col("o_totalprice") / 300)
    state = F.when(F.col("o_orderstatus") == "F", "current").when(
        F.col("o_orderstatus") == "O", "retained"
    ).otherwise("published")
    season = F.when(k % 3 == 0, " ").otherwise("2000/01")
    changes = F.array_join(
        C.class_changes(F.array(F.col("o_orderstatus"), F.lit("B"), F.col("o_orderstatus")), F.lit("F")), ","
    )
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(X.safe_rating(value), 6).alias("rating"),
        X.freshness(season, state, F.col("o_orderdate")).alias("fresh"),
        N.first_nonblank(
            F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(" "), F.col("o_orderstatus")
        ).alias("first"),
        changes.alias("changes"),
    )
