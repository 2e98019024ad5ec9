"""Fixture lines, matches and schedules.

Match rows have ``league, round, home, away, played, home_score, away_score``, a wall-clock
``starts_at`` (NULL when undated) with ``has_time``, and ``position``, the source order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cup_round_weight, is_cup
from ..functions.dates import berlin_to_utc, german_date
from ..functions.seasons import clean
from ..functions.text import (
    club_base_name,
    is_bye,
    is_bye_key,
    schedule_team_key,
    squeeze,
    team_key,
)
from ..lineage import cut_lineage
from .identity import club_match
from .ordering import dedupe_first, keep_one, top_k

_W = r"[\s\u00a0]"


def _words(text: Column) -> tuple[Column, Column]:
    """Words of a cleaned text, plain and with the white space before them (NBSP included)."""
    return F.split(text, f"{_W}+"), F.regexp_extract_all(text, F.lit(rf"{_W}*[^\s\u00a0]+"), F.lit(0))


def _between(words: Column, start: Column, stop: Column) -> Column:
    """Text of the words ``start`` to ``stop`` (from 0, without ``stop``) as it stands in the line."""
    return clean(F.array_join(F.slice(words, start + 1, F.when(stop >= start, stop - start)), ""))


def _once(rows: DataFrame, keep: list[str], **read: Column) -> DataFrame:
    """``rows`` with the columns of ``read``, computed once: a later filter on them is not pushed
    into the steps that read the words, where it would repeat each of them."""
    values = F.struct(*[c.alias(name) for name, c in read.items()])
    return rows.select(*keep, F.explode(F.array(values)).alias("_read")).select(
        *keep, *[F.col("_read")[name].alias(name) for name in read]
    )


def _dash(plain: Column, start: Column, stop: Column) -> Column:
    """Place of the first lone dash with a word before and behind it, between two places."""
    inner = F.slice(plain, start + 2, F.greatest(stop - start - 2, F.lit(0)))
    place = F.array_position(inner, "-").cast("int")
    return F.when(place > 0, start + place)


def _part(c: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def match_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines of multi-line round texts with their number; blank lines are dropped."""
    keep = [c for c in texts.columns if c != text]
    return texts.select(
        *keep, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")
    ).where(clean(F.col("line")) != "")


def _word(i: Column | int) -> Column:
    return F.get("_p", F.lit(i) if isinstance(i, int) else i)


def _fixture_head(rows: DataFrame) -> DataFrame:
    """``rows`` of words with the text of the date, the time and the place behind both.

    A date is one word or two ('6. 9.2025'); one abbreviation may stand before it.
    """

    def date_words(i: int) -> Column:
        two = _word(i).rlike(r"^\d\d?\.$") & _word(i + 1).rlike(r"^\d\d?\.\d{2,4}$")
        return F.when(_word(i).rlike(r"^\d\d?\.\d\d?\.\d{2,4}$"), 1).when(two, 2)

    first, second = date_words(0), F.when(_word(0).rlike(r".\.$"), date_words(1))
    rows = rows.withColumn("_at", F.when(second.isNotNull(), 1).when(first.isNotNull(), 0))
    rows = rows.withColumn("_n", F.coalesce(second, first))
    behind = F.col("_at") + F.col("_n")
    timed = _word(behind).rlike(r"^\d\d?:\d\d$")
    return rows.withColumns({
        "_day": F.array_join(F.slice("_p", F.col("_at") + 1, F.col("_n")), ""),
        "_time": F.when(timed, _word(behind)),
        "_from": behind + F.coalesce(timed.cast("int"), F.lit(0)),
    })


def _score_words() -> Column:
    """How many words at the end are the score: '3:1', also spaced, or the signs of an open one."""
    last, second, third = (_word(F.size("_p") - n) for n in (1, 2, 3))
    number, left, right = r"^\d+$", r"^\d+:$", r"^:\d+$"
    one = last.isin("---", ":") | last.rlike(r"^\d+:\d+$")
    two = second.rlike(left) & last.rlike(number) | second.rlike(number) & last.rlike(right)
    three = third.rlike(number) & (second == ":") & last.rlike(number)
    return F.when(one, 1).when(two, 2).when(three, 3).otherwise(0)


def parse_fixtures(lines: DataFrame, line: str = "line") -> DataFrame:
    """Strict fixture lines, classified in the order bye, missing_time, invalid_time, game.

    ``error`` is set for a line that cannot be read; filter on it for the quarantine.
    """
    plain, spaced = _words(clean(F.col(line)))
    rows = lines.select(*lines.columns, plain.alias("_p"), spaced.alias("_w"))
    rows = _fixture_head(rows).withColumn("_end", F.size("_p") - _score_words())
    rows = rows.withColumn("_cut", _dash(F.col("_p"), F.col("_from"), F.col("_end")))
    rows = _once(
        rows, lines.columns,
        _time=F.col("_time"),
        _date=F.when(F.col("_time").isNotNull(), F.concat_ws(" ", "_day", "_time")),
        home=_between(F.col("_w"), F.col("_from"), F.col("_cut")),
        away=_between(F.col("_w"), F.col("_cut") + 1, F.col("_end")),
    ).withColumn("_utc", berlin_to_utc(german_date(F.col("_date"))["ts"]))
    rows = rows.withColumn("home_key", team_key(F.col("home"))).withColumn(
        "away_key", team_key(F.col("away"))
    )
    readable = F.col("home").isNotNull() & F.col("away").isNotNull()
    bye = is_bye_key(F.col("home_key")) | is_bye_key(F.col("away_key"))
    kind = (
        F.when(~readable, None)
        .when(bye, "bye")
        .when(F.col("_time").isNull(), "missing_time")
        .when(F.col("_utc").isNull(), "invalid_time")
        .otherwise("game")
    )
    return (
        rows.withColumn("classification", kind)
        .withColumn("starts_at_utc", F.when(F.col("classification") == "game", F.col("_utc")))
        .withColumn("error", F.when(~readable, "unreadable fixture line"))
        .drop("_time", "_date", "_utc")
    )


def parse_matches(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lenient match lines: split at the first ' - ', date and time cut off, score at the end.

    '---' and ':' are unplayed; lines without a separator and bye lines are dropped.
    """
    text = clean(F.col(line))
    rows = lines.withColumn("_text", text).where(F.col("_text").contains(" - "))
    at = F.instr(F.col("_text"), " - ")
    rows = rows.withColumn("_left", clean(F.substring("_text", F.lit(1), at - 1)))
    rows = rows.withColumn("_right", clean(F.substring("_text", at + 3, F.length("_text"))))
    left, right = F.col("_left"), F.col("_right")
    timed = _part(left, rf"\d{{1,2}}:\d{{2}}{_W}+(.+)", 1)
    dated = _part(left, rf"\d{{1,2}}\.{_W}*\d{{1,2}}\.\d{{4}}{_W}+(.+)", 1)
    scored = rf"^(.+?){_W}+(\d+):(\d+)$"
    unscored = rf"^(.+?){_W}+(?:---|:)$"
    home_score = _part(right, scored, 2).try_cast("bigint")
    date_text = (
        rf"(?:[A-Za-z]{{2}}\.{_W}+)?(\d{{1,2}}\.{_W}*\d{{1,2}}\.\d{{4}}(?:{_W}+\d{{1,2}}:\d{{2}})?)"
    )
    out = _once(
        rows, lines.columns,
        date_text=F.coalesce(_part(left, date_text, 1), F.lit("")),
        home=clean(F.coalesce(timed, dated, left)),
        away=clean(F.coalesce(_part(right, scored, 1), _part(right, unscored, 1), right)),
        home_score=home_score,
        away_score=_part(right, scored, 3).try_cast("bigint"),
        played=home_score.isNotNull(),
    )
    return out.where(
        (F.col("home") != "")
        & (F.col("away") != "")
        & (F.col("home") != "Spielfrei")  # fixed value: label of a bye
        & (F.col("away") != "Spielfrei")
    )


def both_sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each team's point of view, without a join."""
    return matches.withColumn(
        "_s",
        F.explode(
            F.array(
                F.struct(
                    F.col("home").alias("team"), F.col("away").alias("opponent"),
                    F.lit(True).alias("is_home"), F.col("home_score").alias("own_score"),
                    F.col("away_score").alias("opponent_score"),
                ),
                F.struct(
                    F.col("away").alias("team"), F.col("home").alias("opponent"),
                    F.lit(False).alias("is_home"), F.col("away_score").alias("own_score"),
                    F.col("home_score").alias("opponent_score"),
                ),
            )
        ),
    ).select(*matches.columns, "_s.*")


def result_of(own: Column, other: Column) -> Column:
    """Won / Lost / Draw, pending while a score is missing."""
    return (
        F.when(own.isNull() | other.isNull(), "pending")
        .when(own > other, "Won")
        .when(own < other, "Lost")
        .otherwise("Draw")
    )


def team_schedule(matches: DataFrame, team: str | None = None) -> DataFrame:
    """Schedule of one team, or of every team: opponent, side and result.

    Teams are compared by their schedule key, so 'X' is not 'X 2'.
    """
    sides = both_sides(matches)
    if team is not None:
        wanted = schedule_team_key(F.lit(team))
        sides = sides.where(
            (schedule_team_key(F.col("team")) == wanted) & (F.length(wanted) >= 2)
        )
    return sides.withColumn("result", result_of(F.col("own_score"), F.col("opponent_score")))


def all_league_schedule(matches: DataFrame, team: str) -> DataFrame:
    """A team's matches over all leagues, tagged with the league."""
    return team_schedule(matches, team).orderBy("round", "position")


def league_teams(matches: DataFrame) -> DataFrame:
    """Distinct team names with more than two characters."""
    names = matches.select(F.explode(F.array("home", "away")).alias("team")).distinct()
    return names.where(F.length("team") > 2).orderBy("team")


def club_teams(teams: DataFrame, club: Column, name: str = "team") -> DataFrame:
    """Teams whose schedule key contains the club's."""
    return teams.where(schedule_team_key(F.col(name)).contains(schedule_team_key(club)))


def parse_archive_matches(tables: DataFrame) -> DataFrame:
    """Match rows of archive tables ``(table_id, headers, row_no, cells)`` by header words.

    Without all of the headers the usual positions are used: columns 2, 4, 5, 6 when the second
    cell is a date, else the first four.
    """
    heads = F.transform("headers", lambda h: F.lower(clean(h)))

    def column(pattern: str) -> Column:
        hits = F.transform(
            heads, lambda h, i: F.when(h.rlike(pattern), i)
        )
        return F.array_min(hits)

    found = tables.select(
        "*",
        column("datum").alias("_d"), column("heim").alias("_h"), column("gast").alias("_a"),
        column("ergebnis|punkte").alias("_r"),
    )
    named = (
        F.col("_d").isNotNull() & F.col("_h").isNotNull()
        & F.col("_a").isNotNull() & F.col("_r").isNotNull()
    )

    def cell(i: Column | int) -> Column:
        index = F.lit(i) if isinstance(i, int) else i
        return F.coalesce(clean(F.get("cells", index)), F.lit(""))

    wide = (F.size("cells") >= 6) & cell(1).rlike(r"^\d{2}\.\d{2}\.\d{4}")

    def pick(by_header: str, wide_at: int, plain_at: int) -> Column:
        return (
            F.when(named, cell(F.col(by_header))).when(wide, cell(wide_at)).otherwise(cell(plain_at))
        )

    keep = [c for c in tables.columns if c not in ("headers", "cells")]
    return found.select(
        *keep,
        pick("_d", 1, 0).alias("date_text"),
        pick("_h", 3, 1).alias("home"),
        pick("_a", 4, 2).alias("away"),
        pick("_r", 5, 3).alias("score"),
    )


def coalesce_score(texts: Sequence[Column], homes: Sequence[Column], aways: Sequence[Column]) -> Column:
    """``(home, away)`` when every score field that is present agrees, else NULL.

    ``texts`` are 'h:a' fields; ``homes`` and ``aways`` separate numbers as text.
    """
    pattern = rf"^{_W}*(0|[1-9][0-9]*){_W}*:{_W}*(0|[1-9][0-9]*){_W}*$"
    number = r"^(0|[1-9][0-9]*)$"

    def pair(h: Column, a: Column) -> Column:
        return F.when(
            h.isNotNull() & a.isNotNull(),
            F.struct(h.try_cast("bigint").alias("home"), a.try_cast("bigint").alias("away")),
        )

    read = [
        F.when(t.isNotNull(), F.struct(
            F.lit(True).alias("present"),
            pair(_part(t, pattern, 1), _part(t, pattern, 2)).alias("score"),
        ))
        for t in texts
    ] + [
        F.when(h.isNotNull() & a.isNotNull(), F.struct(
            F.lit(True).alias("present"),
            pair(_part(h, number, 1), _part(a, number, 1)).alias("score"),
        ))
        for h in homes
        for a in aways
    ]
    present = F.filter(F.array(*read), lambda r: r.isNotNull())
    distinct = F.array_distinct(F.transform(present, lambda r: r["score"]))
    no_home = F.coalesce(*homes).isNull() if homes else F.lit(True)
    no_away = F.coalesce(*aways).isNull() if aways else F.lit(True)
    return F.when((F.size(distinct) == 1) & (no_home == no_away), F.get(distinct, F.lit(0)))


def _cup_pattern() -> str:
    """A whole cup line: date, time, first side (behind a time or not), second side and both scores.

    Groups are possessive, so no choice is taken back: the first word that ends in a date, a time behind
    it if a side and a lone dash follow, the first lone dash with a word before and behind it, the first
    score. ``end`` is what ``$`` allows behind a word that is read up to its end. The white space is
    that of ``_W``, character by character, which is the fastest to look up.
    """
    space, end = r"[ \t\n\x0B\f\r\u00a0]", r"[\u0085\u2028\u2029]?"
    word = rf"{space.replace('[', '[^')}++"
    dash = rf"{space}++-{space}++"
    side = rf"({word}(?:{space}++(?!-{space}){word})*+)"
    date = rf"(?>.*?(\d\d\.\d\d\.\d{{4}}){end}(?={space}))"
    sides = rf"(?>({space}++\d\d:\d\d{end}){space}++{side}{dash}|{space}++{side}{dash})"
    return rf"(?s)^{date}{sides}(.*?){space}(\d++){space}*+:{space}*+(\d+).*$"


def parse_cup_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Cup lines with a mandatory date and score, which may stand anywhere in the line.

    The first word that ends in a date opens the sides, perhaps after a time; the first lone dash
    divides them, and the first score behind the second side closes them. A line is read by one
    pattern, whose parts come with a mark between them that no text holds.
    """
    mark, held, other = "\x01", "\x02a", "\x02b"
    put = lambda c, *pairs: c if not pairs else put(
        F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]
    )
    text = put(clean(F.col(line)), ("\x02", other), (mark, held))
    # Without a side behind it a time is the side itself.
    read = F.regexp_replace(text, _cup_pattern(), mark.join(["$1$2", "$3$4", "$5", "$6", "$7"]))
    rows = lines.select(*lines.columns, F.split(read, mark).alias("_p"))
    side = lambda i: put(F.get("_p", F.lit(i)), (held, mark), (other, "\x02"))
    rows = _once(
        rows, lines.columns,
        date_text=F.get("_p", F.lit(0)),
        home=side(1),
        away=clean(side(2)),
        home_score=F.get("_p", F.lit(3)).try_cast("bigint"),
        away_score=F.get("_p", F.lit(4)).try_cast("bigint"),
    )
    return rows.where(F.col("home").isNotNull())


def cup_lines_of_clubs(parsed: DataFrame, clubs: DataFrame) -> DataFrame:
    """Parsed cup lines with a side that belongs to one of the ``clubs``, each line once.

    ``clubs``: club. Names belong to a club as in ``club_match``. Sides are matched as distinct names;
    a name that stands in many lines costs no more than one. The lines are written, as they are read
    for the names and again for the result. So are the distinct names, else what ``club_match`` asks of
    a name would be pushed to every line, and the names found, whose size Spark knows then.
    """
    parsed = cut_lineage(parsed, "cup-lines")
    names = parsed.select(F.explode(F.array("home", "away")).alias("target")).distinct()
    own = club_match(clubs, cut_lineage(names, "cup-names")).select("target").distinct()
    own = cut_lineage(own, "cup-names-found")
    kept = parsed
    for side in ("home", "away"):
        found = own.select(F.col("target").alias(side), F.lit(True).alias(f"_{side}"))
        kept = kept.join(found, side, "left")
    return kept.where(F.col("_home") | F.col("_away")).select(*parsed.columns)


# --- meetings --------------------------------------------------------------------------------


def fixture_pair() -> Column:
    """The two teams of a match in a fixed order, folded like the meeting search."""
    fold = lambda c: F.lower(squeeze(F.col(c)))
    return F.array_sort(F.array(fold("home"), fold("away")))


def meetings(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Played meetings of each ``(team_a, team_b)``, in either orientation, with A's scores."""
    fold = lambda c: F.lower(squeeze(F.col(c)))
    wanted = pairs.withColumn("_pair", F.array_sort(F.array(fold("team_a"), fold("team_b"))))
    played = matches.where("played").withColumn("_pair", fixture_pair())
    joined = played.join(wanted, "_pair").drop("_pair")
    a_home = fold("home") == fold("team_a")
    return joined.select(
        "*",
        F.when(a_home, F.col("home_score")).otherwise(F.col("away_score")).alias("a_score"),
        F.when(a_home, F.col("away_score")).otherwise(F.col("home_score")).alias("b_score"),
    )


def meeting_record(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Wins, draws and losses of team A in its meetings with team B.

    Results are counted per orientation before the pairs are joined, so a pair that meets very
    often moves a handful of rows only.
    """
    fold = lambda c: F.lower(squeeze(F.col(c)))
    sides = both_sides(matches.where("played")).where(fold("home") != fold("away"))
    counts = sides.groupBy(fold("team").alias("_a"), fold("opponent").alias("_b")).agg(
        F.count_if(F.col("own_score") > F.col("opponent_score")).alias("wins"),
        F.count_if(F.col("own_score") == F.col("opponent_score")).alias("draws"),
        F.count_if(F.col("own_score") < F.col("opponent_score")).alias("losses"),
    )
    keyed = pairs.withColumn("_a", fold("team_a")).withColumn("_b", fold("team_b"))
    zero = F.lit(0).cast("bigint")
    return keyed.join(counts, ["_a", "_b"], "left").select(
        *pairs.columns,
        *[F.coalesce(c, zero).alias(c) for c in ("wins", "draws", "losses")],
    )


# --- selection and order ------------------------------------------------------------------------


def upcoming(matches: DataFrame, now: Column) -> DataFrame:
    """Matches still to play: no bye; timed from now on, date-only from today on, undated kept."""
    start, today = F.col("starts_at"), now.cast("date")
    later = (
        F.when(start.isNull(), True)
        .when(F.col("has_time"), start >= now)
        .otherwise(start.cast("date") >= today)
    )
    return matches.where(
        ~F.col("played") & ~is_bye(F.col("home")) & ~is_bye(F.col("away")) & later
    )


def upcoming_order() -> list[Column]:
    """Dated before undated, by day, timed before date-only, by time, by source position."""
    return [
        F.col("starts_at").isNull().asc(),
        F.col("starts_at").cast("date").asc_nulls_last(),
        F.col("has_time").desc(),
        F.col("starts_at").asc_nulls_last(),
        F.col("position").asc(),
    ]


def order_upcoming(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*upcoming_order())


def next_games(matches: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The next ``k`` games of each group in upcoming order."""
    return top_k(matches, by, upcoming_order(), k, "place")


def recent_games(matches: DataFrame, by: Sequence[str], k: int = 30) -> DataFrame:
    """The last ``k`` played games of each group, newest first."""
    order = [F.col("starts_at").desc_nulls_last(), F.col("position").asc()]
    return top_k(matches.where("played"), by, order, k, "place")


def drop_withdrawn(matches: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Remove unplayed matches of withdrawn teams ``(league, team)``."""
    gone = withdrawn.select("league", "team").distinct()
    played = matches.where("played")
    left = matches.where(~F.col("played"))
    for side in ("home", "away"):
        left = left.join(gone.withColumnRenamed("team", side), ["league", side], "left_anti")
    return played.unionByName(left.select(*played.columns))


def game_key(date_text: str = "date_text") -> Column:
    """``league|home|away|date`` key of a game; NULL when a name is blank."""
    fold = lambda c: F.lower(squeeze(F.coalesce(F.col(c), F.lit(""))))
    day = F.date_format("starts_at", "yyyy-MM-dd")
    time = F.when(F.col("has_time"), F.date_format("starts_at", "HH:mm:ss")).otherwise("date-only")
    date = F.coalesce(F.concat_ws(":", day, F.when(day.isNotNull(), time)), F.lit(""))
    date = F.when(day.isNull(), fold(date_text)).otherwise(date)
    named = (fold("league") != "") & (fold("home") != "") & (fold("away") != "")
    return F.when(named, F.concat_ws("|", fold("league"), fold("home"), fold("away"), date))


def dedupe_games(matches: DataFrame, date_text: str = "date_text") -> DataFrame:
    """Keep the first of games with one key; games without a key all stay."""
    return dedupe_first(matches, game_key(date_text), "position")


def dedupe_best(items: DataFrame, date_text: str = "date_text") -> DataFrame:
    """One archive match per day and club: both teams known, longest score, first in source.

    Items without any team name are dropped.
    """
    letters = lambda c: F.regexp_replace(
        F.lower(club_base_name(F.col(c))), "[^a-z]", ""
    )
    rows = items.withColumn("_h", letters("home")).withColumn("_a", letters("away"))
    day = F.substring_index(F.col(date_text), " ", 1)
    club = F.coalesce(F.nullif("_h", F.lit("")), F.nullif("_a", F.lit("")))
    length = F.length(F.concat(F.coalesce("score_home", F.lit("")), F.coalesce("score_away", F.lit(""))))
    both = (F.col("_h") != "") & (F.col("_a") != "")
    keyed = rows.withColumn("_day", day).withColumn("_club", club).where(
        F.col("_club").isNotNull()
    )
    best = F.struct((~both).cast("int"), -length, F.col("position"))
    return keep_one(keyed, ["_day", "_club"], best, items.columns)


def next_matches(matches: DataFrame, team: Column, now: Column) -> DataFrame:
    """Unplayed matches of a team in every league, today or later, undated last."""
    from .identity import strict_contains_match

    fold = lambda c: F.lower(squeeze(c))
    mine = strict_contains_match(fold(F.col("home")), fold(team)) | strict_contains_match(
        fold(F.col("away")), fold(team)
    )
    far = F.to_timestamp_ntz(F.lit("9999-01-01 00:00:00"))
    start = F.coalesce(F.col("starts_at"), far)
    return matches.where(~F.col("played") & mine & (start >= now.cast("date"))).orderBy(
        start, "position"
    )


# --- archive ------------------------------------------------------------------------------------


def split_archive(items: DataFrame) -> DataFrame:
    """Section (league / cup), kind (match / table) and round weight of archive items."""
    cup = F.coalesce("is_cup", F.lit(False)) | is_cup(F.col("league"))
    return items.select(
        "*",
        F.when(cup, "cup").otherwise("league").alias("section"),
        F.when(F.col("is_table"), "table").otherwise("match").alias("kind"),
        cup_round_weight(F.col("league")).alias("round_weight"),
    )


def order_archive(items: DataFrame) -> DataFrame:
    """Newest season first, later cup rounds first."""
    return items.orderBy(F.col("season").desc(), F.col("round_weight").desc(), "league", "position")


def round_order(name: str = "round_name") -> list[Column]:
    """Natural order of round names: by their leading number, others by text."""
    number = F.regexp_extract(name, r"^\s*(\d+)", 1).try_cast("bigint")
    return [number.asc_nulls_last(), F.col(name)]


def order_rounds(df: DataFrame, name: str = "round_name") -> DataFrame:
    return df.orderBy(*round_order(name))


def flag_incomplete(items: DataFrame) -> DataFrame:
    """Cup matches that miss a team or a score, and their label."""
    blank = lambda c: F.coalesce(squeeze(F.col(c)), F.lit("")) == ""
    missing = blank("home") | blank("away") | blank("score_home") | blank("score_away")
    bye = F.coalesce("is_bye", F.lit(False))
    incomplete = ~bye & (F.col("section") == "cup") & missing
    score = F.concat(
        F.coalesce("score_home", F.lit("")), F.lit(":"), F.coalesce("score_away", F.lit(""))
    )
    label = F.when(bye, "bye").when(incomplete, "incomplete").otherwise(score)
    return items.withColumn("incomplete", incomplete).withColumn("label", label)


def fill_byes(played: DataFrame, rounds: DataFrame) -> DataFrame:
    """Cup rounds ``(season, round_name)`` a club skipped up to its furthest round.

    ``played`` has season, club, round_name. Only the furthest round per season and club is
    joined to the rounds of that season.
    """
    done = played.select("season", "club", "round_name").distinct()
    reach = done.groupBy("season", "club").agg(
        F.max(cup_round_weight(F.col("round_name"))).alias("_reach")
    )
    weighted = rounds.select("season", "round_name").distinct().withColumn(
        "round_weight", cup_round_weight(F.col("round_name"))
    )
    due = reach.join(weighted, "season").where(
        (F.col("round_weight") > 0) & (F.col("round_weight") <= F.col("_reach"))
    )
    return due.join(done, ["season", "club", "round_name"], "left_anti").select(
        "season", "club", "round_name", "round_weight"
    )


def cup_entries(tables: DataFrame) -> DataFrame:
    """Cup tables with at least two rows by season label; ``tables``: season, league, rows, n_rows."""
    name = F.lower("league")
    season = F.replace(squeeze(F.col("season")), F.lit("/"), F.lit("-"))
    cup = name.contains("ligapokal") | name.contains("liga-pokal")
    return tables.where(
        cup & (F.col("n_rows") >= 2) & season.rlike(r"^\d{4}-\d{4}$")
    ).withColumn("season_label", F.concat(F.lit("Ligapokal "), season))

