"""Queries: snapshot payloads, page tables, headings, fields and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rankings import ranking_long
from ..lineage import new_path
from ..sources import pages as P
from ..sources.sinks import content_hash, publish_run, read_published, run_report
from ..sources.snapshots import (
    import_history,
    league_lines,
    parse_snapshot,
    read_history,
    replace_seasons,
    write_history,
)
from .gate_queries import _RESULTS_SQL, _results
from .registry import query
from .roles import SEGMENTS_SQL, segments, table, with_ctes


@query("S1_parse_snapshot", """
SELECT o_orderkey, CASE o_custkey % 5 WHEN 1 THEN 'wrong name' WHEN 2 THEN 'duplicate key'
    WHEN 3 THEN 'constant' WHEN 4 THEN 'syntax' END AS issue,
  CASE WHEN o_custkey % 5 = 0 THEN o_orderkey END AS k,
  CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus END AS status FROM orders""")
def _snapshot(spark, d):
    kind = F.col("o_custkey") % 5
    name = F.when(kind == 1, "window.OTHER = ").when(kind == 2, "").otherwise("window.ORDERS = ")
    extra = F.when(kind == 2, F.lit(', "k": 1')).when(kind == 3, ', "x": NaN').when(kind == 4, ",").otherwise("")
    text = F.concat(
        name, F.lit('{"k": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'),
        F.col("o_orderstatus"), F.lit('"'), extra, F.lit("};\n"),
    )
    # A plain payload may not end with ';'.
    text = F.when(kind == 2, F.regexp_replace(text, ";", "")).otherwise(text)
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return parse_snapshot(rows, "text", "ORDERS", "k bigint, status string").select(
        "o_orderkey", "issue", "data.k", "data.status"
    )


@query("S2_league_lines", """
SELECT 'L' || o_custkey AS league, o_orderkey || '. Spieltag' AS round_name,
  CAST(i * 2 AS INTEGER) AS line_no, CASE i WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS line
FROM orders, (VALUES (0), (1)) v(i)""")
def _league_lines(spark, d):
    text = F.concat_ws("\n", "o_orderstatus", F.lit("  "), "o_orderpriority", F.lit(""))
    rounds = F.create_map(F.concat(F.col("o_orderkey").cast("string"), F.lit(". Spieltag")), text)
    league = F.struct(F.lit("u").alias("url"), rounds.alias("match_days"), F.lit("").alias("table"))
    data = F.struct(
        F.create_map(F.concat(F.lit("L"), F.col("o_custkey").cast("string")), league).alias("leagues")
    )
    return league_lines(table(spark, d, "orders").select(data.alias("data")))


@query("S3_ranking_long", """
SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
  CAST(month(l_shipdate) AS BIGINT) AS round, CAST(l_quantity AS BIGINT) AS points FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 13, NULL FROM lineitem""")
def _ranking_long(spark, d):
    month = F.concat(F.lit("R"), F.month("l_shipdate").cast("string"))
    rounds = F.create_map(
        month, F.col("l_quantity").cast("bigint").cast("string"), F.lit("R13"), F.lit("x"),
        F.lit("R0"), F.lit("5"), F.lit("Summe"), F.lit("9"),
    )
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"), rounds.alias("rounds"),
    )
    return ranking_long(rows, ["o", "n", "p", "s"]).drop("raw")


def _pages(spark, d):
    """Stored pages, each with two tables of its own id and URL at the end."""
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;"))
    extra = F.concat(
        F.lit("</article><h2>Tabelle  A-Klasse</h2><table class='x'><thead><tr><th>Nr</th><th colspan='2'>URL"
              "</th></tr></thead><tbody><tr><td rowspan='200'> "),
        cell("page_id"), F.lit("<script>var x = '<td>';</script></td><td><b>"), cell("url"),
        F.lit("</b><table><tr><td>inner</td></tr></table> </td></tr></tbody></table>"
              "<table><tr><td>"), cell("page_id"), F.lit("</table>"),
    )
    return table(spark, d, "pages").withColumn("html", F.concat("html", extra))


@query("S5_extract_tables", """
SELECT page_id, 0 AS table_no, 'thead' AS section, 0 AS row_no, 'Nr|URL' AS cells, '|colspan=2' AS spans
FROM pages
UNION ALL SELECT page_id, 0, 'tbody', 1, page_id || '|' || url, '|' FROM pages
UNION ALL SELECT page_id, 1, '', 0, CAST(page_id AS VARCHAR), '' FROM pages""")
def _tables(spark, d):
    return P.extract_tables(_pages(spark, d)).select(
        "page_id", "table_no", "section", "row_no", F.array_join("cells", "|").alias("cells"),
        F.array_join("spans", "|").alias("spans"),
    )


@query("S6_attach_headings", """
SELECT page_id, 0 AS table_no, 'A-Klasse' AS heading FROM pages
UNION ALL SELECT page_id, 1, NULL FROM pages""")
def _headings(spark, d):
    league = F.nullif(F.regexp_extract("text", r"([ABC]-Klasse)", 1), F.lit(""))
    return P.attach_headings(P.extract_elements(_pages(spark, d)), league).select(
        "page_id", "table_no", "heading"
    )


def _section_rows(spark, d):
    k = F.col("o_custkey")
    row = lambda n, *cells: F.struct(
        F.lit(n).alias("row_no"), F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).alias("cells")
    )
    key = F.col("o_orderkey").cast("string")
    rows = F.array(
        F.when(k % 2 == 0, row(0, "Liga Nord")),
        row(1, "Datum", "Heim", "Gast", "Ergebnis"),
        row(2, "Runde 1"),
        row(3, "1.1.", key, "B", "9:7"),
        row(4, "Achtelfinale", ""),
        F.when(k % 5 != 0, row(5, "2.1.", "C", key, "8:8")),
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("table_id"), F.col("o_orderpriority").alias("title"),
        F.explode(F.array_compact(rows)).alias("r"),
    ).select("table_id", "title", "r.*")


_SECTIONS_SQL = """
t AS (SELECT o_orderkey AS table_id, CASE WHEN o_custkey % 2 = 0 THEN 'Liga Nord' ELSE o_orderpriority END
  AS title FROM orders WHERE o_custkey % 5 <> 0)"""


@query("S7_carry_sections", with_ctes(_SECTIONS_SQL) + """
SELECT table_id, title, 1 AS row_no, 'Runde/Info|Datum|Heim|Gast|Ergebnis' AS cells FROM t
UNION ALL SELECT table_id, title, 3, 'Runde 1|1.1.|' || table_id || '|B|9:7' FROM t
UNION ALL SELECT table_id, title, 5, 'Achtelfinale|2.1.|C|' || table_id || '|8:8' FROM t""")
def _sections(spark, d):
    return P.carry_sections(_section_rows(spark, d)).withColumn("cells", F.array_join("cells", "|"))


@query("S7_initial_section", with_ctes(_SECTIONS_SQL) + """
, s AS (SELECT table_id, title, CASE WHEN table_id % 3 = 0 THEN '' ELSE 'Gruppe ' || table_id % 3 END AS x FROM t)
SELECT table_id, title, 0 AS row_no, x || '|1.1.|' || table_id || '|A|9:7' AS cells FROM s
UNION ALL SELECT table_id, title, 1, 'Runde/Info|Datum|Heim|Gast|Ergebnis' FROM s
UNION ALL SELECT table_id, title, 2, x || '|2.1.|' || table_id || '|B|8:8' FROM s
UNION ALL SELECT table_id, title, 4, 'Achtelfinale|3.1.|C|' || table_id || '|7:9' FROM s""")
def _outer_sections(spark, d):
    """The section that stands before the table holds for its first rows."""
    k, key = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    row = lambda n, *cells: F.struct(
        F.lit(n).alias("row_no"), F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]).alias("cells")
    )
    rows = F.array(
        row(0, "1.1.", key, "A", "9:7"),
        row(1, "Datum", "Heim", "Gast", "Ergebnis"),
        F.when(k % 5 != 0, row(2, "2.1.", key, "B", "8:8")),
        row(3, "Achtelfinale", ""),
        F.when(k % 5 != 0, row(4, "3.1.", "C", key, "7:9")),
        F.when(k % 2 == 0, row(5, "Liga Nord")),
    )
    group = F.col("o_orderkey") % 3
    tables = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("table_id"), F.col("o_orderpriority").alias("title"),
        F.when(group > 0, F.concat(F.lit("Gruppe "), group.cast("string"))).alias("before"),
        F.explode(F.array_compact(rows)).alias("r"),
    ).select("table_id", "title", "before", "r.*")
    return P.carry_sections(tables, section_col="before").withColumn("cells", F.array_join("cells", "|"))


@query("S8_classify_tables", """
SELECT o_orderkey AS table_id, CAST(4 - CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END
  + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) + 1 AS rows
FROM orders WHERE o_custkey % 2 = 1""")
def _classify(spark, d):
    return P.classify_tables(_section_rows(spark, d))


@query("S9_extract_fields", """
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS venue,
  c_mktsegment AS city, 'www' || c_custkey AS website, '' AS phone FROM customer""")
def _fields(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("Ort:")
    text = F.concat(
        F.lit("Verein\nVeranstaltungsort\n"), name, F.lit("\nOrt:\t"), F.col("c_mktsegment"),
        F.lit("\nWWW:\t\nWebseite\n  www"), F.col("c_custkey").cast("string"),
        F.lit("\nTelefon\nImpressum\nTelefon\t123"),
    )
    lines = table(spark, d, "customer").select(
        F.col("c_custkey").alias("page_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )
    fields = {
        "venue": ["Veranstaltungsort"], "city": ["Ort"], "website": ["WWW", "Webseite"], "phone": ["Telefon"],
    }
    return P.extract_fields(lines, fields, ["Impressum"])


_HOST = "www.example.org"


@query("S10_extract_links", f"""
SELECT DISTINCT 'https://{_HOST}' || p AS url, p[2:] AS text FROM (
  SELECT unnest(regexp_extract_all(html, '<a href="(/[^"]*)">', 1)) AS p FROM pages)""")
def _links(spark, d):
    return P.extract_links(table(spark, d, "pages"), _HOST, ["/"])


@query("S10_canonical_url", f"""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://{_HOST}/archiv/' || page_id
  WHEN 1 THEN 'https://{_HOST}/archiv/' || page_id END AS url FROM pages""")
def _urls(spark, d):
    k = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6
    href = (
        F.when(kind == 0, F.concat(F.lit("/archiv/"), k, F.lit("?a=1#b")))
        .when(kind == 1, F.concat(F.lit(f"https://{_HOST}:443/archiv/"), k))
        .when(kind == 2, F.concat(F.lit("/archiv/%2e%2e/"), k))
        .when(kind == 3, F.concat(F.lit(f"https://user@{_HOST}/archiv/"), k))
        .when(kind == 4, F.concat(F.lit("//evil.example/archiv/"), k))
        .otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", P.canonical_url(href, _HOST, ["/archiv/"]).alias("url"))


@query("S11_season_index", """
SELECT year(o_orderdate) || '/' || (year(o_orderdate) + 1) AS season,
  'https://h/archiv/' || lpad(CAST(min(o_orderkey) AS VARCHAR), 12, '0') AS url
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY year(o_orderdate)""")
def _index(spark, d):
    y = F.year("o_orderdate")
    url = F.concat(F.lit("https://h/archiv/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    text = F.when(
        F.col("o_orderpriority") == "5-LOW",
        F.concat(F.lit("Saison "), F.concat_ws("/", y, y + 1), F.lit(" und "), F.concat_ws("/", y + 1, y + 2)),
    ).otherwise(F.concat(F.lit("Saison "), F.concat_ws("-", y, y + 1)))
    return P.season_index(table(spark, d, "orders").select(url.alias("url"), text.alias("text")))


@query("S12_club_index", """
SELECT 'u' || o_custkey AS url, lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') AS number,
  string_agg(DISTINCT 'DC ' || o_orderstatus, ' ' ORDER BY 'DC ' || o_orderstatus) AS name
FROM orders GROUP BY o_custkey""")
def _clubs(spark, d):
    number = F.lpad((F.col("o_custkey") % 1000).cast("string"), 4, "0")
    url = F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url")
    rows = table(spark, d, "orders")
    links = rows.select(url, F.concat(F.lit("DC "), "o_orderstatus").alias("text")).unionByName(
        rows.select(url, number.alias("text"))
    )
    return P.club_index(links)


@query("Q10_safe_tables", """
SELECT page_id, ['comments', NULL, 'forbidden elements', 'nested tables', 'cell attributes',
  'invalid span', 'text outside cells', 'no rows'][page_id % 8 + 1] AS issue FROM pages""")
def _safe(spark, d):
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    cell = lambda attr, inner="": F.concat(
        F.lit(f"<table><tr><td{attr}>"), url, F.lit(f"{inner}</td></tr></table>")
    )
    variants = [
        F.concat(F.lit("<!-- x -->"), cell("")), cell(' rowspan="2"'), cell("", "<b>x</b>"),
        cell("", "<table><tr><td>1</td></tr></table>"), cell(' class="a"'), cell(' colspan="0"'),
        F.concat(url, cell("")), F.concat(cell(""), F.lit("<table></table>")),
    ]
    fragment = F.element_at(F.array(*variants), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", P.safe_table_issue(fragment).alias("issue"))


@query("S13_run_report", with_ctes(_RESULTS_SQL) + """
SELECT CAST(90 AS BIGINT) AS duration_seconds, true AS success,
  'leagues=publish;rankings=retain;clubs=publish;archives=publish' AS decisions
FROM (SELECT count(*) FROM results)""")
def _report(spark, d):
    results = _results(spark, d).withColumn("reasons", F.array().cast("array<string>"))
    report = run_report(results, "2001-01-01T10:00:00Z", "2001-01-01T10:01:30Z")
    text = F.array_join(
        F.transform("domains", lambda x: F.concat_ws("=", x["domain"], x["decision"])), ";"
    )
    return report.select("duration_seconds", "success", text.alias("decisions"))


@query("S14_content_hash", """
SELECT count(*) AS rows, true AS reordered_equal, false AS changed_equal FROM lineitem""")
def _content(spark, d):
    rows = table(spark, d, "lineitem")
    changed = rows.withColumn(
        "l_tax", F.when(F.col("l_returnflag") == "R", -1.0).otherwise(F.col("l_tax"))
    )
    base = content_hash(rows).select("rows", F.col("content_hash").alias("a"))
    one = base.withColumn("b", content_hash(rows.repartition("l_partkey")).select("content_hash").scalar())
    one = one.withColumn("c", content_hash(changed).select("content_hash").scalar())
    return one.select(
        "rows", (F.col("a") == F.col("b")).alias("reordered_equal"),
        (F.col("a") == F.col("c")).alias("changed_equal"),
    )


@query("S14_publish_run", """
SELECT 'customers' AS domain, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, 1 AS changes
FROM customer
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), 2 FROM orders
WHERE month(o_orderdate) <> 3""")
def _publish_run(spark, d):
    """Four runs: all orders, fewer orders, the same again, and one that is not ready."""
    target = new_path(spark, "published")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    fewer = orders.where(F.month("o_orderdate") != 3)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    changes = []
    for rows, ready in ((orders, True), (fewer, True), (fewer, True), (orders, False)):
        changes += publish_run({"orders": rows, "customers": customers}, target, ready)
    out = None
    for domain in ("customers", "orders"):
        row = read_published(spark, target, domain).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys")
        ).select(F.lit(domain).alias("domain"), "rows", "keys", F.lit(changes.count(domain)).alias("changes"))
        out = row if out is None else out.unionByName(row)
    return out


@query("ST2_running_means", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id, count(value) AS games,
  round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def _running(spark, d):
    from ..streaming.feeds import running_means

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return running_means(events, player="user_id", points="value").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "user_id", "games",
        F.round("mean", 6).alias("mean"),
    )


@query("S4_seasons_written_and_read", with_ctes(SEGMENTS_SQL) + """
, newest AS (SELECT max(season_start) AS y FROM segments)
SELECT player_id, season_start, class_ord, club_no, rank, appearances,
  points + CASE WHEN season_start = y THEN 1 ELSE 0 END AS points
FROM segments, newest WHERE season_start >= y - 1""")
def _history_folders(spark, d):
    """All segments written by season, the newest season replaced, the two newest read back."""
    columns = ["player_id", "season_start", "class_ord", "club_no", "rank", "appearances", "points"]
    rows, path = segments(spark, d).select(*columns), new_path(spark, "history")
    write_history(rows, path)
    newest = read_history(spark, path).agg(F.max("season_start")).first()[0]
    changed = rows.where(F.col("season_start") == newest).withColumn("points", F.col("points") + 1)
    replace_seasons(changed, path)
    return read_history(spark, path, [newest, newest - 1]).select(*columns)


@query("S4_import_history", """
SELECT CAST(o_custkey AS VARCHAR) AS player_id, CAST(i AS INTEGER) AS position,
  CAST(year(o_orderdate) + i AS INTEGER) AS season_start, o_orderkey AS points
FROM orders, (VALUES (0), (1)) v(i)""")
def _import(spark, d):
    year = F.year("o_orderdate")
    record = lambda y: F.struct(y.alias("season_start"), F.col("o_orderkey").alias("points"))
    histories = F.create_map(
        F.col("o_custkey").cast("string"), F.array(record(year), record(year + 1))
    )
    return import_history(table(spark, d, "orders").select(histories.alias("histories")))
