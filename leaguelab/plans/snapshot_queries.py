"""Queries: snapshot differences, event state and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut_lineage, new_path
from ..operators import diffs as D
from ..operators import events as E
from ..operators.identity import resolve_teams
from ..streaming import feeds
from .registry import query
from .roles import MATCHES_SQL, matches, table, with_ctes


# --- plain differences -------------------------------------------------------------------------------


def _orders(spark, d):
    """Previous and candidate orders: March is gone, cheap April orders changed, May is new."""
    orders = table(spark, d, "orders")
    month = F.month("o_orderdate")
    cheap = (month == 4) & (F.col("o_totalprice") < 100000)
    candidate = orders.where(month != 3).withColumn(
        "o_orderstatus", F.when(cheap, "X").otherwise(F.col("o_orderstatus"))
    )
    return orders.where(month != 5), candidate


@query("J16_diff_by_key", """
SELECT o_orderkey, CASE month(o_orderdate) WHEN 3 THEN 'removed' WHEN 5 THEN 'added' ELSE
  CASE WHEN month(o_orderdate) = 4 AND o_totalprice < 100000 THEN 'changed' ELSE 'same' END END AS change
FROM orders""")
def _diff(spark, d):
    return D.diff_by_key(*_orders(spark, d), ["o_orderkey"], ["o_orderkey", "o_orderstatus"]).select(
        "o_orderkey", "change"
    )


@query("U1_lost_seasons", """
SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS season FROM orders WHERE month(o_orderdate) = 3""")
def _lost(spark, d):
    season = F.date_format("o_orderdate", "yyyy-MM")
    previous, candidate = _orders(spark, d)
    return D.lost_seasons(previous.withColumn("season", season), candidate.withColumn("season", season))


@query("U6_plain_changes", """
SELECT o_orderkey, 'o_orderstatus' AS field, CASE WHEN month(o_orderdate) = 5 THEN NULL
    ELSE o_orderstatus END AS previous,
  CASE month(o_orderdate) WHEN 3 THEN NULL WHEN 5 THEN o_orderstatus ELSE 'X' END AS current
FROM orders WHERE month(o_orderdate) IN (3, 5) OR (month(o_orderdate) = 4 AND o_totalprice < 100000)
UNION ALL
SELECT o_orderkey, 'o_custkey', CASE WHEN month(o_orderdate) = 3 THEN CAST(o_custkey AS VARCHAR) END,
  CASE WHEN month(o_orderdate) = 5 THEN CAST(o_custkey AS VARCHAR) END
FROM orders WHERE month(o_orderdate) IN (3, 5)""")
def _plain(spark, d):
    return D.plain_changes(*_orders(spark, d), "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("U7_refresh_changes", """
WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1),
c AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE month(o_orderdate) <> 3 GROUP BY 1)
SELECT k AS o_custkey, coalesce(p.n, 0) AS previous, coalesce(c.n, 0) AS current,
  coalesce(c.n, 0) - coalesce(p.n, 0) AS delta FROM p FULL JOIN c USING (k)""")
def _refresh(spark, d):
    count = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    previous, candidate = _orders(spark, d)
    return D.refresh_changes(count(previous), count(candidate), "o_custkey", "n")


@query("Q12_same_rows", """
SELECT 'same' AS pair, count(*) AS rows_a, count(*) AS rows_b, CAST(0 AS BIGINT) AS unequal FROM lineitem
UNION ALL
SELECT 'changed', (SELECT count(*) FROM lineitem),
  (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R'), (SELECT count(*) FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem
    WHERE l_returnflag = 'R' GROUP BY ALL))""")
def _same(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    part = rows.where(F.col("l_returnflag") != "R")
    same = D.same_rows(rows, rows).select(F.lit("same").alias("pair"), "*")
    return same.unionByName(D.same_rows(rows, part).select(F.lit("changed").alias("pair"), "*"))


@query("A23_results_fingerprint", with_ctes(MATCHES_SQL) + """
SELECT home, count(*) AS result_count, true AS reordered_equal, home <> 'NATION_3' AS changed_equal
FROM matches WHERE played GROUP BY 1""")
def _results(spark, d):
    games = matches(spark, d)
    score = F.when(F.col("home") == "NATION_3", F.col("home_score") + 1).otherwise(F.col("home_score"))
    pick = lambda df, name: D.results_fingerprint(df, ["home"]).select(
        "home", F.col("result_count").alias(f"n_{name}"), F.col("result_fingerprint").alias(name)
    )
    out = pick(games, "a").join(pick(games.repartition("line_no"), "b"), "home").join(
        pick(games.withColumn("home_score", score), "c"), "home"
    )
    return out.select(
        "home", F.col("n_a").alias("result_count"),
        (F.col("a") == F.col("b")).alias("reordered_equal"),
        (F.col("a") == F.col("c")).alias("changed_equal"),
    )


def _visit(spark, d, current: bool):
    k = F.col("o_custkey")
    hit = lambda n: (k % n == 0) if current else F.lit(False)
    text = lambda n, new, old: F.when(hit(n), new).otherwise(old)
    opponent = F.when(k % 17 == 0, None) if not current else F.when(k % 19 == 0, None)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("visitor"), F.lit("p").alias("player"),
        F.when(hit(3), 6).otherwise(5).alias("rank"), F.when(hit(5), 11).otherwise(10).alias("points"),
        text(7, "k2", "k1").alias("source_key"), F.lit("s").alias("source_season"),
        F.lit("current").alias("source_state"), F.lit("A-Klasse").alias("class"),
        F.lit("t").alias("team"), F.when(hit(11), 4).otherwise(3).alias("result_count"),
        text(13, "f2", "f1").alias("result_fingerprint"), F.lit("k").alias("team_source_key"),
        F.lit("s").alias("team_source_season"), F.lit("current").alias("team_source_state"),
        F.lit("g").alias("game_key"), text(23, "d2", "d1").alias("game_date"),
        F.lit("l").alias("game_location"),
        opponent.otherwise("o").alias("game_opponent"),
        F.lit("v2" if current else "v1").alias("data_key"),
        F.lit(2 if current else 1).alias("updated_at"),
    )


@query("U5_visit_changes", """
WITH c AS (SELECT o_orderkey AS visitor, o_custkey AS k FROM orders),
x AS (
  SELECT visitor, 'rank' AS type, '5 -> 6' AS detail FROM c WHERE k % 3 = 0 AND k % 7 <> 0
  UNION ALL SELECT visitor, 'points', '10 -> 11' FROM c WHERE k % 5 = 0 AND k % 7 <> 0
  UNION ALL SELECT visitor, 'results', CASE WHEN k % 11 = 0 THEN 'new' ELSE 'updated' END FROM c
    WHERE k % 11 = 0 OR k % 13 = 0
  UNION ALL SELECT visitor, 'nextGame', CASE WHEN k % 17 = 0 THEN 'set' WHEN k % 19 = 0 THEN 'cancelled'
    ELSE 'rescheduled' END FROM c
    WHERE (k % 17 = 0) <> (k % 19 = 0) OR (k % 23 = 0 AND k % 17 <> 0 AND k % 19 <> 0))
SELECT * FROM x UNION ALL SELECT visitor, 'data', 'newer' FROM c
WHERE visitor NOT IN (SELECT visitor FROM x)""")
def _visits(spark, d):
    return D.visit_changes(_visit(spark, d, False), _visit(spark, d, True))


# --- archive tables ----------------------------------------------------------------------------------


def _tables(spark, d, candidate: bool):
    k, month = F.col("o_custkey") % 4, F.month("o_orderdate")
    titles = ["c klasse", "a klasse", "b klasse", "pokal"] if candidate else [
        "unbekannt", "a klasse mitte", "b klasse runde", "pokal",
    ]
    families = ["c-klasse", "a-klasse", "b-klasse", "pokal"]
    if not candidate:
        families[0] = None
    pick = lambda values: F.element_at(
        F.array(*[F.lit(v).cast("string") for v in values]), (k + 1).cast("int")
    )
    shrunk = (k == 3) & (month == 7) & F.lit(candidate)
    rows = table(spark, d, "orders")
    if candidate:
        rows = rows.where((month != 6) | (k == 3))
    return rows.select(
        F.year("o_orderdate").alias("season_key"),
        F.concat(F.col("o_custkey").cast("string"), F.when(shrunk, "x").otherwise("")).alias("rows_hash"),
        pick(titles).alias("title"), pick(families).alias("family"),
        (F.lit(not candidate) & (k == 2)).alias("partition"),
        (F.col("o_custkey") % 5 + 2 - F.when(shrunk, 1).otherwise(0)).alias("n_rows"),
    )


@query("Q8_tables_no_loss", """
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season_key,
  ['unbekannt', 'a klasse mitte', 'b klasse runde', 'pokal'][o_custkey % 4 + 1] AS title,
  CASE WHEN o_custkey % 4 = 3 THEN 'row count' ELSE 'table count' END AS reason
FROM orders WHERE o_custkey % 4 = 2 OR (o_custkey % 4 IN (0, 1) AND month(o_orderdate) = 6)
  OR (o_custkey % 4 = 3 AND month(o_orderdate) = 7)""")
def _table_loss(spark, d):
    return D.check_tables_no_loss(_tables(spark, d, False), _tables(spark, d, True))


@query("J19_match_archive_tables", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS season_key,
  ['unbekannt', 'a klasse mitte', 'b klasse runde', 'pokal'][o_custkey % 4 + 1] AS title,
  count(*) AS unmatched FROM orders
WHERE o_custkey % 4 = 2 OR (o_custkey % 4 IN (0, 1) AND month(o_orderdate) = 6)
  OR (o_custkey % 4 = 3 AND month(o_orderdate) = 7) GROUP BY 1, 2""")
def _match_tables(spark, d):
    left, _ = D.match_archive_tables(_tables(spark, d, False), _tables(spark, d, True))
    return left.groupBy("season_key", "title").agg(F.sum("n").alias("unmatched"))


# --- event state -------------------------------------------------------------------------------------

_FIXTURES_SQL = """
fx AS (SELECT o_orderkey, o_orderpriority AS pr, o_orderdate AS starts_at, h.n_name AS home,
    a.n_name AS away, h.n_nationkey AS hk, a.n_nationkey AS ak
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation h ON h.n_nationkey = c_nationkey
  JOIN nation a ON a.n_nationkey = (c_nationkey + 1) % 25),
ev AS (SELECT *, hk AS tk, home AS team_name, away AS opponent, true AS is_home FROM fx
  UNION ALL SELECT *, ak, away, home, false FROM fx),
known AS (SELECT * FROM ev WHERE tk % 5 <> 0)"""


def _fixtures(spark, d):
    nation = table(spark, d, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home"))
    away = nation.select(((F.col("n_nationkey") + 24) % 25).alias("c_nationkey"), F.col("n_name").alias("away"))
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(home, "c_nationkey").join(away, "c_nationkey")
        .select(
            F.lit("2000-2001").alias("season"), F.lit("A-Klasse 2000-2001").alias("league"),
            F.col("o_orderkey").cast("string").alias("round_name"), "home", "away",
            F.col("o_orderdate").alias("starts_at"), F.lit(None).cast("string").alias("location"),
            F.when(F.col("o_orderpriority") == "2-HIGH", "no address").alias("location_warning"),
            F.col("o_orderpriority").alias("priority"), F.lit("game").alias("classification"),
        )
    )


def _event_teams(spark, d):
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey")
    clubs = nation.select(
        key.cast("string").alias("number"),
        # Every fifth club has a name that no team bears, so its teams stay unresolved. A trailing
        # number would read as a team number, so the club carries it as part of its name.
        F.when(key % 5 == 0, F.concat(F.lit("Umland "), "n_name")).otherwise(F.col("n_name")).alias("name"),
    )
    names = nation.select(F.col("n_name").alias("team"))
    return resolve_teams(names, clubs)


def _event_sources(spark, d):
    """Fixtures and resolved teams, written once for all states and events made of them."""
    return cut_lineage(_fixtures(spark, d), "fixtures"), cut_lineage(_event_teams(spark, d), "teams")


@query("C1_team_events", with_ctes(_FIXTURES_SQL) + """
SELECT CAST(o_orderkey AS VARCHAR) AS round_name, 'club-' || tk || '-team-1' AS team_id, team_name,
  opponent, is_home, strftime(starts_at, '%Y-%m-%d') AS day FROM known""")
def _events(spark, d):
    return E.team_events(_fixtures(spark, d), _event_teams(spark, d)).select(
        "round_name", "team_id", "team_name", "opponent", "is_home",
        F.date_format("starts_at", "yyyy-MM-dd").alias("day"),
    )


def _previous_state(fixtures, teams, keep=()):
    """State before the run: everything but the unspecified orders; urgent ones are cancelled."""
    kept = fixtures.where(F.col("priority") != "4-NOT SPECIFIED")
    events = E.team_events(kept, teams, ["priority"])
    marked = events.withColumn(
        "status", F.when(F.col("priority") == "1-URGENT", E.CANCELLED).otherwise(F.col("status"))
    )
    return (
        marked.withColumn("fingerprint", E.event_fingerprint())
        .withColumn("sequence", F.lit(2)).withColumn("last_modified", F.lit("old"))
        .select(*E.STATE, *keep)
    )


def _run_events(fixtures, teams):
    """Events of the run: urgent and low orders are gone, high ones moved by a day."""
    fixtures = fixtures.where(~F.col("priority").isin("1-URGENT", "5-LOW"))
    moved = F.when(
        F.col("priority") == "2-HIGH", F.col("starts_at") + F.expr("INTERVAL '1' DAY")
    ).otherwise(F.col("starts_at"))
    return E.team_events(fixtures.withColumn("starts_at", moved), teams)


def _merged(fixtures, teams):
    return E.merge_state(
        _previous_state(fixtures, teams), _run_events(fixtures, teams), F.lit("2000-2001"), F.lit("now")
    )


_MERGED_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS round_name, 'club-' || tk || '-team-1' AS team_id,
  CASE WHEN pr IN ('1-URGENT', '5-LOW') THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status,
  CAST(CASE pr WHEN '4-NOT SPECIFIED' THEN 0 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 2 ELSE 3 END
    AS INTEGER) AS sequence,
  CASE WHEN pr IN ('1-URGENT', '3-MEDIUM') THEN 'old' ELSE 'now' END AS last_modified FROM known"""


@query("C2_merge_state", with_ctes(_FIXTURES_SQL) + _MERGED_SQL)
def _merge(spark, d):
    return _merged(*_event_sources(spark, d)).select("round_name", "team_id", "status", "sequence", "last_modified")


@query("C2_merge_state_twice", with_ctes(_FIXTURES_SQL) + _MERGED_SQL)
def _merge_twice(spark, d):
    sources = _event_sources(spark, d)
    again = E.merge_state(_merged(*sources), _run_events(*sources), F.lit("2000-2001"), F.lit("later"))
    return again.select("round_name", "team_id", "status", "sequence", "last_modified")


@query("C3_feed_teams", """
SELECT 'club-' || n_nationkey || '-team-1' AS team_id, n_name AS team FROM nation
WHERE n_nationkey % 5 <> 0 AND (n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders
  ON o_custkey = c_custkey) OR (n_nationkey + 24) % 25 IN (SELECT c_nationkey FROM customer JOIN orders
  ON o_custkey = c_custkey))""")
def _feed_teams(spark, d):
    return E.feed_teams(_fixtures(spark, d), _event_teams(spark, d)).select("team_id", "team")


@query("C4_future_events", with_ctes(_FIXTURES_SQL) + """
SELECT CAST(o_orderkey AS VARCHAR) AS round_name, team_name FROM known
WHERE pr NOT IN ('1-URGENT', '5-LOW') AND starts_at + to_days(CASE WHEN pr = '2-HIGH' THEN 1 ELSE 0 END)
  >= TIMESTAMP '1999-01-01'""")
def _future(spark, d):
    now = F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))
    return E.future_events(_merged(*_event_sources(spark, d)), now).select("round_name", "team_name")


@query("A22_event_index", with_ctes(_FIXTURES_SQL) + """
SELECT 'club-' || tk || '-team-1' AS team_id, max(team_name) AS name, count(*) AS events,
  CAST(sum(CASE WHEN pr = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM known GROUP BY 1""")
def _index(spark, d):
    sources = _event_sources(spark, d)
    return E.event_index(_merged(*sources), E.feed_teams(*sources))


@query("Q16_check_state", with_ctes(_FIXTURES_SQL) + """
SELECT CAST(o_orderkey AS VARCHAR) AS round_name, 'club-' || tk || '-team-1' AS team_id,
  CAST(1 AS INTEGER) AS failed FROM known WHERE pr IN ('3-MEDIUM', '5-LOW')""")
def _check_state(spark, d):
    state = cut_lineage(_previous_state(*_event_sources(spark, d), ["priority"]), "state")
    broken = (
        state
        .withColumn("opponent", F.when(F.col("priority") == "3-MEDIUM", "?").otherwise(F.col("opponent")))
        .withColumn("sequence", F.when(F.col("priority") == "5-LOW", -1).otherwise(F.col("sequence")))
        .select(*E.STATE)
    )
    return E.check_state(broken, ["round_name"]).select(
        "round_name", "team_id", F.size("reasons").alias("failed")
    )


@query("Q17_check_index", with_ctes(_FIXTURES_SQL) + """
SELECT 'club-' || tk || '-team-1' AS team_id, CASE WHEN tk % 4 = 1 THEN 'event count'
  ELSE 'no feed' END AS reason FROM known WHERE tk % 4 IN (1, 2) GROUP BY 1, 2""")
def _check_index(spark, d):
    sources = _event_sources(spark, d)
    teams = E.feed_teams(*sources)
    state = cut_lineage(_merged(*sources), "state")
    number = F.split_part("team_id", F.lit("-"), F.lit(2)).try_cast("int") % 4
    index = E.event_index(state, teams).withColumn(
        "events", F.when(number == 1, F.col("events") + 1).otherwise(F.col("events"))
    )
    return E.check_index(index, state, teams.where(number != 2))


# --- incidents ---------------------------------------------------------------------------------------


@query("W23_incidents", """
WITH r AS (SELECT *, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS n
  FROM r WHERE failed)
SELECT f.user_id, strftime(min(ts) FILTER (n = 2), '%Y-%m-%d %H:%M:%S') AS opened_at,
  (SELECT strftime(min(s.ts), '%Y-%m-%d %H:%M:%S') FROM r s WHERE NOT s.failed AND s.user_id = f.user_id
    AND s.stretch = f.stretch + 1) AS closed_at, count(*) AS failures
FROM f GROUP BY f.user_id, f.stretch HAVING count(*) >= 2""")
def _incidents(spark, d):
    runs = table(spark, d, "events").select(
        "user_id", "ts", F.col("event_id").alias("run_id"), (F.col("event_type") == "error").alias("failed")
    )
    fmt = "yyyy-MM-dd HH:mm:ss"
    return E.incidents(runs, ["user_id"]).select(
        "user_id", F.date_format("opened_at", fmt).alias("opened_at"),
        F.date_format("closed_at", fmt).alias("closed_at"), "failures",
    )


# Three snapshots of all orders as events, each in several files; the stream merges them in order.
# Low orders leave in the second and come back in the third; medium ones leave in the third; high
# ones move in the second; urgent ones begin there.
@query("ST1_streamed_state", """
SELECT CAST(o_orderkey AS VARCHAR) AS uid,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status,
  CAST(CASE o_orderpriority WHEN '5-LOW' THEN 2 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 1 ELSE 0 END
    AS INTEGER) AS sequence,
  CASE o_orderpriority WHEN '5-LOW' THEN 3 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 2
    WHEN '1-URGENT' THEN 2 ELSE 1 END AS hour
FROM orders""")
def _streamed(spark, d):
    folder = new_path(spark, "streamed")
    priority = F.col("o_orderpriority")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")

    def event(hour):
        moved = F.when((priority == "2-HIGH") & F.lit(hour > 1), "hall 2").otherwise("hall 1")
        own = {
            "uid": F.col("o_orderkey").cast("string"), "season": F.lit("2000-2001"),
            "starts_at": F.col("o_orderdate").cast("timestamp_ntz"), "location": moved,
            "status": F.lit("CONFIRMED"), "is_home": F.lit(True),
            "snapshot_at": F.timestamp_seconds(F.lit(946684800 + 3600 * hour)),
        }
        fields = [x.strip().split(" ") for x in feeds.EVENT_SCHEMA.split(",")]
        return [own.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]

    for hour, missing in ((1, "1-URGENT"), (2, "5-LOW"), (3, "3-MEDIUM")):
        rows = orders.where(priority != missing).select(*event(hour))
        rows = rows.withColumn("fingerprint", E.event_fingerprint())
        rows.repartition(3, "uid").write.mode("append").parquet(f"{folder}/in")
        if hour != 1:  # the first two come together
            feeds.stream_event_state(
                spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks"
            ).awaitTermination()
    hour = ((F.unix_seconds("last_modified") - 946684800) / 3600).cast("int")
    return feeds.latest_state(spark, f"{folder}/out").select(
        "uid", "status", "sequence", hour.alias("hour")
    )
