"""Operators on small literal tables, where the expected rows can be read off."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from leaguelab.functions import cells, dates, seasons, text
from leaguelab.operators import calibration as K
from leaguelab.operators import careers, diffs, events, gates, history, identity, matches, outcome, rankings, roster
from leaguelab.operators.ordering import largest_remainder, top_k, with_position
from leaguelab.sources import pages, sinks, snapshots


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


# --- ordering -------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_position_on_a_hot_group(spark, parts):
    """One group has most rows and almost all values are ties; positions are still exact."""
    rng = random.Random(5)
    data = [(("hot" if i % 10 else f"g{i % 4}"), rng.choice([1, 1, 1, 2]), i) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(parts)
    out = with_position(df, ["g"], [F.col("v").desc(), "id"], {"run": F.col("v")}, totals=True)
    expected = []
    for g in {r[0] for r in data}:
        members = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        total, run = sum(r[1] for r in members), 0
        for n, r in enumerate(members, 1):
            run += r[1]
            expected.append((g, r[2], n, len(members), run, total))
    assert rows(out, "g", "id", "position", "position_count", "run", "run_total") == sorted(expected)


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = top_k(df, ["g"], [F.col("id").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_largest_remainder_adds_up_to_100(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 0.0), ("b", 2, 5.0)], "g string, p int, s double"
    )
    assert rows(largest_remainder(df, ["g"], "s", "p"), "g", "p", "percent") == [
        ("a", 1, 34), ("a", 2, 33), ("a", 3, 33), ("b", 1, 0), ("b", 2, 100),
    ]


# --- functions ------------------------------------------------------------------------------------


def test_two_year_season_is_consecutive(spark):
    old = value(spark, seasons.canonical_season(F.lit("2020/2022")))
    new = value(spark, seasons.canonical_season(F.lit("22/23")))
    assert old["key"] == "2020/22" and old["end"] == new["start"]


def test_no_break_space_counts_as_white_space(spark):
    assert value(spark, text.squeeze(F.lit(" A  B "))) == "A B"
    assert value(spark, cells.round_number(F.lit("Runde 12"))) == 12


def test_unsafe_integer_is_an_error(spark):
    cell = value(spark, cells.round_value(F.lit(str(2**53))))
    assert cell["points"] is None and cell["error"]


@pytest.mark.parametrize(
    "wall, strict, lenient",
    [
        ("2026-08-24 20:00:00", "2026-08-24 18:00:00", "2026-08-24 18:00:00"),
        ("2026-03-29 02:30:00", None, None),
        ("2026-10-25 02:30:00", None, "2026-10-25 00:30:00"),
        ("2026-10-25 03:00:00", "2026-10-25 02:00:00", "2026-10-25 02:00:00"),
    ],
)
def test_local_time(spark, wall, strict, lenient):
    ts = F.to_timestamp_ntz(F.lit(wall))
    show = lambda v: None if v is None else str(v)
    assert show(value(spark, dates.berlin_to_utc(ts))) == strict
    assert show(value(spark, dates.berlin_to_utc(ts, strict=False))) == lenient


# --- rankings -------------------------------------------------------------------------------------


def test_marker_rows_and_compensation(spark):
    long = spark.createDataFrame(
        [(1, 1, 5, None), (1, 2, None, "x"), (1, 3, 7, None), (1, 4, None, "d"), (2, 1, 0, None)],
        "player_id int, round int, points bigint, marker string",
    )
    assert rows(rankings.player_means(long, ["player_id"]), "*") == [(1, 2, 6.0), (2, 1, 0.0)]
    assert rows(rankings.total_with_compensation(long, ["player_id"]), "*") == [(1, 18.0), (2, 0.0)]


def test_shared_display_ranks(spark):
    long = spark.createDataFrame(
        [(i, 1, 3, p, "A") for i, p in enumerate([9, 9, 7, 0])],
        "player_id int, season_start int, round int, points int, class string",
    )
    assert rows(rankings.matchday_top(long), "player_id", "display_rank") == [(0, 1), (1, 1), (2, 3)]


def test_career_takes_the_first_best_season(spark):
    past = spark.createDataFrame(
        [(1, 2000, 1, "A", 1, 50), (1, 2001, 0, "B", 2, 50)],
        "player_id int, season_start int, class_ord int, league string, rank int, points int",
    )
    got = careers.career(past).head()
    assert (got.best_season, got.titles, got.highest_class, got.seasons) == (2000, 1, "Bezirksliga", 2)


# --- calibration ----------------------------------------------------------------------------------


def _moves(spark, players, low=45, high=40):
    """Players whose mean is 40 in the A class and 45 in the B class a season later."""
    data = []
    for p in range(players):
        data.append((p, 2000, 2001, 1, high * 10, 10, 1, True, False))
        data.append((p, 2001, 2002, 2, low * 10, 10, 1, True, False))
    return spark.createDataFrame(
        data,
        "player_id bigint, season_start int, season_end int, class_ord int, points bigint, "
        "appearances bigint, segments bigint, eligible boolean, ambiguous boolean",
    )


@pytest.mark.parametrize("players, published", [(8, True), (7, False)])
def test_edges_need_eight_observations(spark, players, published):
    history_rows = _moves(spark, players)
    totals = history.season_class_totals(history_rows)
    edges = K.calibrate_classes(K.transitions(K.season_rows(history_rows, totals)))
    got = edges.head()
    assert (got["edge"], got["offset"], got["published"]) == (1, 5.0, published)


def test_prior_converts_old_seasons(spark):
    """Eight movers give offset 5, so an A-class mean of 40 is a B-class prior of 45."""
    history_rows = _moves(spark, 8)
    totals = history.season_class_totals(history_rows)
    targets = spark.createDataFrame([(0, 2002, 2)], "player_id bigint, cutoff int, target_ord int")
    seasons_df, means, edges = K.calibration_tables(history_rows, totals, targets)
    got = K.historical_prior(targets, seasons_df, totals, means, edges).head()
    assert got["prior"] == pytest.approx(45.0) and got["confidence"] == "medium"
    assert got["newest_source_end"] <= got["cutoff"]


def test_missing_edge_leaves_the_rating(spark):
    df = spark.createDataFrame([(40.0, None, 5.0, None)], "r double, edge_0 double, edge_1 double, edge_2 double")
    pick = lambda a, b: df.select(K.convert_rating(F.col("r"), F.lit(a), F.lit(b)).alias("c")).head()["c"]
    assert tuple(pick(1, 2)) == (45.0, True)
    assert tuple(pick(2, 1)) == (35.0, True)
    assert tuple(pick(0, 2)) == (40.0, False)


def test_weight_cap_and_weighted_median(spark):
    df = spark.createDataFrame(
        [("e", i, v, w) for i, (v, w) in enumerate([(1.0, 1), (2.0, 1), (3.0, 2), (9.0, 50)])],
        "edge string, id int, value double, raw_weight bigint",
    )
    capped = K.cap_weights(df, ["edge"])
    assert [r[0] for r in rows(capped, "weight")] == [1, 1, 2, 2]
    assert K.weighted_median(capped, ["edge"], "value", "weight").head()["median"] == 3.0


# --- history --------------------------------------------------------------------------------------


def _segment_rounds(spark):
    columns = (
        "player_id string, season_start int, season_end int, segment_id string, name string, "
        "league string, class_ord int, club_no string, rank bigint, round bigint, points bigint"
    )
    base = [
        ("1", 2000, 2001, "a", "Ann", "A-Klasse", 1, "7", 3, 1, 5),
        ("1", 2000, 2001, "b", "Ann", "A-Klasse", 1, "7", 1, 1, 6),
        ("2", 2000, 2001, "c", "Bob", "A-Klasse", 1, "7", 2, 1, 4),
        ("2", 2000, 2001, "d", "Rob", "B-Klasse", 2, None, 2, 3, None),
    ]
    return spark.createDataFrame(base, columns)


def test_ambiguity_flags(spark):
    long = _segment_rounds(spark)
    out = history.merge_segments(history.build_segments(long), long)
    assert rows(out, "player_id", "points", "rank", "identity_ambiguous", "round_overlap_ambiguous") == [
        ("1", 11, 1, False, True), ("2", 4, 2, True, False),
    ]


def test_ambiguous_season_gives_no_totals(spark):
    long = _segment_rounds(spark)
    usable = history.usable_history(history.build_segments(long), long)
    assert history.season_class_totals(usable).count() == 0


def test_latest_affiliation_needs_one_club(spark):
    long = _segment_rounds(spark)
    out = history.latest_affiliation(history.build_segments(long))
    assert rows(out, "player_id", "club_no", "ambiguous") == [("1", "7", False), ("2", "7", False)]


def test_quarantine_of_history_rows(spark):
    headers = spark.createDataFrame(
        [(1, i, h) for i, h in enumerate(["Platz", "V-Nr", "ID", "Name", "Gesamt", "R1", "R2", "R3"])],
        "table_id int, position int, header string",
    )
    data = [
        (1, 1, "24/25", "A-Klasse", ["1.", "12", "7", "Muster, Max", "12", "5", "x", "7"]),
        (1, 2, "24/25", "A-Klasse", ["2", "12", "8", "Eva", "99", "5", "", "7"]),
        (1, 3, "24/25", "A-Klasse", ["", " ", "", "", "", "", "", ""]),
    ]
    table = spark.createDataFrame(
        data, "table_id int, row_no int, season string, league string, cells array<string>"
    )
    got = history.parse_history_rows(table, history.map_history_columns(headers))
    assert rows(got, "row_no", "name", "appearances", "points_per_appearance", "error") == [
        (1, "Max Muster", 2, 6.0, None), (2, "Eva", 2, 49.5, "round total mismatch"),
    ]


# --- matches and identity -------------------------------------------------------------------------


def test_colon_score_is_pending(spark):
    lines = spark.createDataFrame([("Mo. 1. 9.2025 20:00 A - B   :",), ("Mo. 1. 9.2025 A - B 9:7",)], "line string")
    assert matches.team_schedule(matches.parse_matches(lines), "aa").count() == 0
    parsed = matches.team_schedule(matches.parse_matches(lines))
    assert rows(parsed.where("is_home"), "result") == [("Won",), ("pending",)]


def test_fixture_lines_are_read_by_words(spark):
    """Weekday, split dates, no-break spaces, spaced and open scores, dashes inside names."""
    data = [
        (0, "Mo.  6. 9.2025 20:00  SC\u00a0 Berg   -  A-B Tal   3 : 1 "),
        (1, "06.09.25 9:30 A - B - C ---"),
        (2, "Mo. 6.9.2025 A - B :"),
        (3, "Mo. 6. 9.2025 25:00 A - B 3: 1"),
        (4, "6.9.2025 20:00 A - Spielfrei"),
        (5, "6.9.2025 20:00 - B 3:1"),
        (6, "6.9.2025 20:00 A - "),
        (7, "Spielplan A - B"),
        (8, ""),
        (9, None),
        (10, "6. 9.10.2025 20:00 A 5 - B 4 3:1"),
    ]
    df = spark.createDataFrame(data, "n int, line string")
    got = matches.parse_fixtures(df)
    assert rows(got.where("error IS NULL"), "n", "home", "away", "classification") == [
        (0, "SC\u00a0 Berg", "A-B Tal", "game"), (1, "A", "B - C", "game"),
        (2, "A", "B", "missing_time"), (3, "A", "B", "invalid_time"), (4, "A", "Spielfrei", "bye"),
        (10, "A 5", "B 4", "game"),
    ]
    assert sorted(r.n for r in got.where("error IS NOT NULL").collect()) == [5, 6, 7, 8, 9]


def test_cup_lines_are_read_by_words(spark):
    data = [
        (0, "Pokal: 06.09.2025 20:00 A - B\u00a0C 3 : 1 n.V."), (1, "am 06.09.2025 A-B - C - D 3:1"),
        (2, "06.09.2025 A - B ---"), (3, "6.9.2025 A - B 3:1"), (4, "06.09.2025 20:00 - B 3:1"),
        (5, "06.09.2025 - 3:1"), (6, None),
    ]
    df = spark.createDataFrame(data, "n int, line string")
    got = matches.parse_cup_lines(df)
    assert rows(got, "n", "date_text", "home", "away", "home_score", "away_score") == [
        (0, "06.09.2025 20:00", "A", "B\u00a0C", 3, 1), (1, "06.09.2025", "A-B", "C - D", 3, 1),
        (4, "06.09.2025", "20:00", "B", 3, 1),
    ]


def test_filtered_match_lines_are_read_once(spark):
    """A filter on what was read is not repeated in the steps below it."""
    df = spark.createDataFrame([("Mo. 1. 9.2025 20:00 A - B 9:7",)], "line string")
    for read in (matches.parse_matches, matches.parse_fixtures, matches.parse_cup_lines):
        plan = read(df).where("home <> 'x' AND away <> 'y'")
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Generate explode") == 1
        below = text.split("Generate explode")[1].split("\n", 1)[1]
        assert not any("Filter" in x and "array_join" in x for x in below.split("\n"))
        assert len(text) < 40_000


def test_containment_join_is_exact(spark):
    """Against all pairs, with texts that share their pieces."""
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = identity.containment_pairs(
        df.select(F.col("w").alias("needle")), df.select(F.col("w").alias("text")), 4, shorter=True
    )
    expected = {(a, b) for a in words for b in words if a in b}
    assert set(rows(got, "needle", "text")) == expected


@pytest.mark.parametrize("longest", [3, 64])
def test_first_containment_against_all_pairs(spark, longest):
    """Keys of one and two letters, texts over and under the limit, equal positions."""
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("ab") for _ in range(rng.randint(1, most)))
    names = [*{word(7) for _ in range(60)}, "a", "zz", "ab" * 50, "!"]
    options = [(word(6), rng.randint(1, 40)) for _ in range(60)] + [("b", 99), ("ab" * 60, 98)]
    got = identity.exact_then_fuzzy(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(options, "candidate string, position int"), longest,
    )
    first = lambda found: min(((p, c) for c, p in options if found(c)), default=(None, None))[1]
    want = {}
    for name in names:
        exact = first(lambda c: c == name)
        near = first(lambda c: name in c or c in name) if name != "!" else None
        want[name] = exact or near
    assert {r["name"]: r["candidate"] for r in got.collect()} == want
    texts = [(i % 3, n) for i, n in enumerate(names)]
    found = identity.groups_containing(
        spark.createDataFrame(texts, "g int, text string"), ["g"],
        spark.createDataFrame([(n,) for n in names], "needle string"), longest,
    )
    assert set(rows(found, "g", "needle")) == {(g, n) for g, t in texts for n in names if n in t}


def test_a_letter_in_all_candidates_is_one_row(spark):
    """A key meets one entry of the dictionary, whatever the candidates have in common."""
    options = spark.range(3000).select(
        F.concat(F.lit("verein "), F.col("id").cast("string")).alias("candidate"), F.col("id").alias("position")
    )
    names = spark.createDataFrame([("v",), ("verein",), ("e",)], "name string")
    got = identity.exact_then_fuzzy(names, options)
    assert {r["candidate"] for r in got.collect()} == {"verein 0"}
    pieces = identity._substrings(
        options, "candidate", "key", names.select(F.col("name").alias("key")), 64
    )
    assert pieces.groupBy("key").agg(F.min("position")).where(F.col("key").isin("v", "e")).count() == 2


def _archive_rest(previous, candidate):
    """The three passes over lists of single tables (brute force)."""
    left, right = sorted(previous, key=str), sorted(candidate, key=str)
    plain = lambda t: t[3] is not None and not t[4]
    for t in list(left):
        same = [u for u in right if (*u[:3], u[5]) == (*t[:3], t[5])]
        if same:
            left.remove(t), right.remove(same[0])
    for ok, size in ((plain, 4), (lambda t: t[2] == diffs.UNKNOWN_TITLE, 2)):
        bucket = lambda t: (t[0], t[1], t[3] if size == 4 else None)
        a = sorted((t for t in left if ok(t)), key=lambda t: (t[2], t[5]))
        b = sorted((t for t in right if plain(t)), key=lambda t: (t[2], t[5]))
        for t in a:
            other = next((u for u in b if bucket(u) == bucket(t)), None)
            if other is not None:
                b.remove(other), left.remove(t), right.remove(other)
    return left, right


def test_archive_tables_against_single_pairs(spark):
    """Many titles in one bucket, a side that covers the other, copies, families without a value."""
    rng = random.Random(11)
    schema = "season_key string, rows_hash string, title string, family string, partition boolean, n_rows int"

    def tables(n):
        out = []
        for _ in range(n):
            title = rng.choice(["a", "b", "c", "d", "e", "f", diffs.UNKNOWN_TITLE])
            part = bool(len(title) == 1 and title in "ef")
            # Equal titles have equal families and equal rows have one size, as in archive tables.
            out.append((rng.choice("st"), rng.choice("hij"), title, None if title in "ad" else "fam" + str(ord(title[0]) % 2), part, 5))
        return out

    for sizes in ((40, 15), (15, 40), (30, 30), (0, 5)):
        old, new = tables(sizes[0]), tables(sizes[1])
        left, right = diffs.match_archive_tables(
            spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
        )
        spread = lambda df: sorted(
            (tuple(r[c] for c in schema.replace(",", "").split()[::2]) for r in df.collect() for _ in range(r["n"])), key=str
        )
        want_left, want_right = _archive_rest(old, new)
        assert spread(left) == sorted(want_left, key=str)
        # On the right the last pass takes tables of any family in title order.
        assert len(spread(right)) == len(want_right)
        assert [t[:3] for t in spread(right)] == [t[:3] for t in sorted(want_right, key=str)]


def test_team_numbers_resolve_to_slots(spark):
    clubs = spark.createDataFrame([("1", "DC Foo e.V."), ("2", "DC Bär"), ("3", "DC Bar")], "number string, name string")
    teams = spark.createDataFrame([("dc foo 2",), ("DC Foo e.V.",), ("DC Bar",), ("Nobody",)], "team string")
    got = dict(rows(identity.resolve_teams(teams, clubs), "team", "team_id"))
    assert got["dc foo 2"] == "club-1-team-2" and got["DC Foo e.V."] == "club-1-team-1"
    assert got["DC Bar"].startswith("team-") and got["Nobody"].startswith("team-")


def test_byes_are_filled_up_to_the_furthest_round(spark):
    played = spark.createDataFrame(
        [("s", "a", "Runde 1"), ("s", "a", "Halbfinale"), ("s", "b", "Runde 2"), ("s", "b", "Finale")],
        "season string, club string, round_name string",
    )
    got = rows(matches.fill_byes(played, played), "club", "round_name")
    assert got == [("a", "Runde 2"), ("b", "Halbfinale"), ("b", "Runde 1")]


# --- roster and outcome ---------------------------------------------------------------------------


def test_pair_share_60_40(spark):
    slot = "struct<slot:int,rating:double,confidence:string,evidence:string,unconfirmed:boolean>"
    df = spark.createDataFrame(
        [([(1, 60.0, "high", "current", False)], [(1, 40.0, "high", "neutral", False)])],
        f"home_slots array<{slot}>, away_slots array<{slot}>",
    )
    got = outcome.pair_matrix(df, []).head()
    assert (got.home_percent, got.away_percent, got.uncertain, got.band) == (60, 40, True, "home")


def test_neutral_slots_make_a_team_very_low(spark):
    teams = spark.createDataFrame([("t", 2001, 1, 30.0)], "team_id string, cutoff int, target_ord int, class_mean double")
    known = spark.createDataFrame(
        [("t", 2001, 1, i, 40.0 + i, "current", "high", False) for i in range(2)],
        "team_id string, cutoff int, target_ord int, player_id int, rating double, evidence string, "
        "confidence string, unconfirmed boolean",
    )
    got = roster.complete_lineup(known, teams).head()
    assert [s.player_id for s in got.slots] == ["1", "0", "neutral-1", "neutral-2"]
    assert got.team_confidence == "very-low"


def test_model_needs_enough_examples(spark):
    data = [(str(i), 5.0, 4.0, "home") for i in range(50)]
    df = spark.createDataFrame(data, "key string, home_rating double, away_rating double, outcome string")
    got = outcome.calibrate_outcome(outcome.usable_examples(df)).head()
    assert got.calibrated is False and got.brier is None


# --- events and incidents -------------------------------------------------------------------------


def test_incident_opens_on_the_second_failure(spark):
    outcomes = "FFFSFSFF"
    runs = spark.createDataFrame(
        [("u", i, i, o == "F") for i, o in enumerate(outcomes)], "u string, ts int, run_id int, failed boolean"
    )
    got = rows(events.incidents(runs, ["u"]), "opened_at", "closed_at", "failures")
    assert got == [(1, 3, 3), (7, None, 2)]


def test_season_change_replaces_the_state(spark):
    columns = ", ".join(f"{c} string" for c in events.CONTENT if c not in ("is_home", "starts_at"))
    base = {c: c for c in events.CONTENT} | {"status": "CONFIRMED"}

    def make(season):
        row = base | {"season": season, "uid": season}
        df = spark.createDataFrame([tuple(row[c] for c in events.CONTENT if c not in ("is_home", "starts_at"))], columns)
        df = df.withColumn("is_home", F.lit(True)).withColumn("starts_at", F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")))
        return df.withColumn("fingerprint", events.event_fingerprint())

    prior = make("old").withColumn("sequence", F.lit(4)).withColumn("last_modified", F.lit("t0"))
    got = events.merge_state(prior.select(*events.STATE), make("new"), F.lit("new"), F.lit("t1"))
    assert rows(got, "season", "status", "sequence", "last_modified") == [("new", "CONFIRMED", 0, "t1")]


def test_effective_rejects_failed_domains(spark):
    data = spark.createDataFrame([("leagues", 1)], "domain string, v int")
    bad = spark.createDataFrame([("leagues", "blocked")], "domain string, decision string")
    with pytest.raises(Exception, match="not usable"):
        gates.effective(data, data, bad).collect()


# --- sources and sinks ----------------------------------------------------------------------------


def test_read_snapshot_files(spark, tmp_path):
    (tmp_path / "a.js").write_text('window.DATA = {"k": 1};\n')
    (tmp_path / "b.js").write_text('window.DATA = {"k": 1, "k": 2};')
    got = snapshots.read_snapshot(spark, str(tmp_path), "DATA", "k bigint")
    assert {(r.k, r.issue) for r in got.select("data.k", "issue").collect()} == {(1, None), (None, "duplicate key")}


def test_publish_only_on_change(spark, tmp_path):
    target = str(tmp_path / "pub")
    one = spark.range(10)
    assert sinks.publish(one, target, "clubs") is True
    assert sinks.publish(one.repartition(3), target, "clubs") is False
    assert sinks.publish(spark.range(11), target, "clubs") is True
    assert sinks.read_published(spark, target, "clubs").count() == 11
    # A run that is not ready is not seen; one with a new and an old domain is seen at once.
    both = {"clubs": spark.range(5), "teams": spark.range(3)}
    assert sinks.publish_run(both, target, ready=False) == []
    assert sinks.published_version(spark, target, "teams") is None
    assert sinks.publish_run(both, target) == ["clubs", "teams"]
    assert sinks.publish_run(both, target) == []
    assert sinks.read_published(spark, target, "clubs").count() == 5


def test_report_rejects_reversed_time(spark):
    results = spark.createDataFrame(
        [(x, "publish", "s", ["r"]) for x in gates.DOMAINS],
        "domain string, decision string, effective_season string, reasons array<string>",
    )
    ok = sinks.run_report(results, "2001-01-01T10:00:00Z", "2001-01-01T10:00:05Z").head()
    assert ok.success and ok.duration_seconds == 5 and ok.domains[0].domain == "leagues"
    with pytest.raises(Exception, match="before it started"):
        sinks.run_report(results, "2001-01-01T10:00:00Z", "2001-01-01T09:00:00Z").collect()


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    segments = history.build_segments(_segment_rounds(spark))
    snapshots.write_history(segments, path)
    back = snapshots.read_history(spark, path, [2000])
    assert back.count() == segments.count()
    assert "PartitionFilters: [" in back._jdf.queryExecution().executedPlan().toString()


def test_heading_serves_one_table(spark):
    html = "<h2>A-Klasse</h2><table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    got = pages.attach_headings(pages.extract_elements(df), F.col("text"))
    assert {(r.table_no, r.heading) for r in got.collect()} == {(0, "A-Klasse"), (1, None)}


@pytest.mark.parametrize("files", [1, 2, 7])
def test_streamed_state_equals_batches(spark, tmp_path, files):
    from leaguelab.streaming.feeds import EVENT_SCHEMA, latest_state, stream_event_state

    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))

    def write(uids, hour, parts=files):
        at = datetime.datetime(2001, 1, 1, hour)
        data = [
            (u, "s", "l", "r", "club-1-team-1", "n", "o", "h", "a", True, at, None, None, "CONFIRMED", None, at)
            for u in uids
        ]
        df = spark.createDataFrame(data, EVENT_SCHEMA.replace("timestamp_ntz", "timestamp"))
        df = df.withColumn("starts_at", F.to_timestamp_ntz(F.lit("2001-05-01 20:00:00")))
        df = df.withColumn("fingerprint", events.event_fingerprint())
        df.repartition(parts).write.mode("append").parquet(source)

    def run(marks=mark):
        stream_event_state(spark, source, state, marks).awaitTermination()

    def got():
        return rows(latest_state(spark, state), "uid", "status", "sequence")

    many = [f"m{n}" for n in range(8)]
    write(["u1", "u2", *many], 1)
    run()
    assert got() == [(u, "CONFIRMED", 0) for u in sorted(["u1", "u2", *many])]
    # The second half of a snapshot in a later batch; the first half is not cancelled.
    write(["u2", "u3", *many[:4]], 2)
    run()
    write(many[4:], 2)
    run()
    want = [("u1", "CANCELLED", 1), ("u2", "CONFIRMED", 0), ("u3", "CONFIRMED", 0)]
    assert got() == sorted([(m, "CONFIRMED", 0) for m in many] + want)
    write(["u1"], 1)  # late: dropped
    run()
    assert got() == sorted([(m, "CONFIRMED", 0) for m in many] + want)
    # Two snapshots in one batch are applied one after the other.
    write(["u1", "u2", *many], 3)
    write(["u2", *many], 4)
    run()
    want = [("u1", "CANCELLED", 3), ("u2", "CONFIRMED", 0), ("u3", "CANCELLED", 1)]
    assert got() == sorted([(m, "CONFIRMED", 0) for m in many] + want)
    # All files again, with a new stream checkpoint: the newest snapshot is merged to the same.
    run(mark + "2")
    assert got() == sorted([(m, "CONFIRMED", 0) for m in many] + want)


def test_uid_twice_in_a_snapshot_has_a_stated_row(spark, tmp_path):
    from leaguelab.streaming.feeds import EVENT_SCHEMA, latest_state, state_merger

    at = datetime.datetime(2001, 1, 1, 1)
    data = [
        ("u", "s", "l", "r", "club-1-team-1", "n", o, "h", "a", True, None, None, None, "CONFIRMED", "f", at)
        for o in ("z", "b", "k")
    ]
    for n, order in enumerate((data, data[::-1])):
        batch = spark.createDataFrame(order, EVENT_SCHEMA).repartition(3)
        state_merger(str(tmp_path / str(n)))(batch, 0)
        assert rows(latest_state(spark, str(tmp_path / str(n))), "uid", "opponent") == [("u", "b")]


def test_damaged_state_is_an_error(spark, tmp_path):
    from leaguelab.streaming.feeds import latest_state

    assert latest_state(spark, str(tmp_path)) is None
    folder = tmp_path / "state" / "version=1"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|infer|read"):
        latest_state(spark, str(tmp_path)).count()



def test_names_fold_alike(spark):
    from leaguelab.functions import text as names

    spellings = ["Groß", "GROSS", "ｇｒｏｓｓ", "Groß", "ﬁn", "FIN", "José", "José"]
    df = spark.createDataFrame(list(enumerate(spellings)), "n int, t string")
    got = [r[0] for r in df.orderBy("n").select(names.folded(F.col("t"))).collect()]
    assert got == ["gross", "gross", "gross", "gross", "fin", "fin", "josé", "josé"]
    low = [r[0] for r in df.orderBy("n").select(names.lowered(F.col("t"))).collect()]
    assert low[0] == "groß" and low[2] == "gross" and low[4] == "fin" and low[7] == "josé"


def test_wide_letters_and_titles(spark):
    from leaguelab.functions.text import is_bye
    from leaguelab.functions.titles import title_identity

    df = spark.createDataFrame([("ｓｐｉｅｌｆｒｅｉ",), ("ﬀ",)], "t string")
    assert [r[0] for r in df.select(is_bye(F.col("t"))).collect()] == [True, False]
    rows = ["Straße 3-2001/02", "STRASSE 3", "Liga Pokal am 1.3.2001", "Halb Finale B-Klasse"]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, t string").orderBy("n")
    got = [tuple(r[0]) for r in df.select(title_identity(F.lit("2001/02"), F.col("t"))).collect()]
    assert got == [
        ("2001/02", "strasse 3", None, False), ("2001/02", "strasse 3", None, False),
        ("2001/02", "liga pokal", "ligapokal", False), ("2001/02", "halb finale b klasse", "b-klasse", True),
    ]


@pytest.mark.parametrize(
    "label, want",
    [
        ("A - Klasse Gruppe 3 / Saison 2001/02", "A-Klasse"), ("aklasse", "A-Klasse"),
        ("Bezirksliga gruppe cup", None), ("-Aklasse", None), ("B-Klasse 2001/05", None),
        ("B-Klasse saison", None), ("C–Klasse Gruppe Pokalrunde", None), ("Bezirksliga 01 / 02", "Bezirksliga"),
    ],
)
def test_league_class_labels(spark, label, want):
    from leaguelab.functions.classes import league_class

    df = spark.createDataFrame([(label,)], "t string")
    assert df.select(league_class(F.col("t"))).first()[0] == want


def test_check_state_reports_every_row_with_its_reasons(spark):
    """Also rows that share a uid and rows without one; columns asked for stay."""
    sources = spark.createDataFrame(
        [(f"r{n}", "A", "B") for n in range(4)], "round_name string, home string, away string"
    ).select(
        F.lit("s").alias("season"), F.lit("l").alias("league"), "round_name", "home", "away",
        F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")).alias("starts_at"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("location_warning"),
        F.substring("round_name", 2, 1).cast("int").alias("n"),
    )
    teams = spark.createDataFrame([("A", "club-1-team-1")], "team string, team_id string")
    found = events.team_events(sources, teams, ["n"])
    state = found.withColumn("sequence", F.lit(0)).withColumn("last_modified", F.lit("t"))
    broken = state.unionByName(state.where("n = 1").withColumn("sequence", F.lit(-1))).withColumn(
        "uid", F.when(F.col("n") == 2, None).otherwise(F.col("uid"))
    ).withColumn("status", F.when(F.col("n") == 3, "LOST").otherwise(F.col("status")))
    got = events.check_state(broken, ["n"])
    assert got.columns == ["uid", "team_id", "n", "reasons"]
    assert sorted((r.n, tuple(r.reasons)) for r in got.collect()) == [
        (1, ("duplicate uid",)), (1, ("duplicate uid", "sequence")),
        (2, ("uid", "fingerprint")), (3, ("fingerprint", "status")),
    ]


def test_odd_cup_lines(spark):
    """No choice is taken back, white space inside a side stays, and any character may stand in one."""
    data = [
        (0, "06.09.2025 20:00 - B 3:1 - C"), (1, "07.09.2025 \n19:30\t- -\u00a0 A  1 -\x0bB 2\r\n10 : 2 3:1"),
        (2, "x06.09.2025 07.09.2025 A - B 3:1"), (3, "06.09.20251 A - B 3:1"), (4, "06.09.2025 A\x01\x02 - \x02a 1:0"),
        (5, "06.09.2025 A - 3:1"), (6, "06.09.2025 A - B 99999999999999999999:1"), (7, "06.09.2025 A -"),
    ]
    got = matches.parse_cup_lines(spark.createDataFrame(data, "n int, line string"))
    assert rows(got, "n", "date_text", "home", "away", "away_score") == [
        (1, "07.09.2025 \n19:30", "-", "A  1 -\x0bB 2", 2), (2, "06.09.2025", "07.09.2025 A", "B", 1),
        (4, "06.09.2025", "A\x01\x02", "\x02a", 0), (6, "06.09.2025", "A", "B", 1),
    ]


def test_usable_history_judges_seasons_and_careers(spark):
    """Two ends of a season or one bad row drop the player; names and rounds make a season ambiguous."""
    data = [
        ("1", 2000, 2001, "a", "Eva", 5), ("1", 2001, 2002, "b", "Eva", 5),
        ("2", 2000, 2001, "c", "Eva", 5), ("2", 2000, 2002, "d", "Eva", 5), ("2", 2003, 2004, "e", "Eva", 5),
        ("3", 2000, None, "f", "Eva", 5), ("3", 2001, 2002, "g", "Eva", 5),
        ("4", 2000, 2001, "h", "Eva", 5), ("4", 2000, 2001, "i", "EVA ", 5), ("4", 2001, 2002, "j", "Eva", 5),
        ("4", 2001, 2002, "k", "Ida", 5), ("5", 2000, 2001, "l", "Eva", 5), ("5", 2000, 2001, "m", "Eva", 6),
        ("5", 2001, 2002, "n", "Eva", 5), (None, 2001, 2002, "o", "Eva", 5),
    ]
    long = spark.createDataFrame(
        data, "player_id string, season_start int, season_end int, segment_id string, name string, points bigint"
    ).withColumns({
        "league": F.lit("A"), "class_ord": F.lit(0), "club_no": F.lit("7"), "rank": F.lit(1).cast("bigint"),
        "round": F.lit(1).cast("bigint"),
    })
    got = history.usable_history(history.build_segments(long), long)
    assert rows(got, "segment_id", "ambiguous") == [
        ("a", False), ("b", False), ("h", False), ("i", False), ("j", True), ("k", True),
        ("l", True), ("m", True), ("n", False),
    ]
