"""Teams, clubs and people: exact, alias and containment matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    club_alias,
    club_base_key,
    is_bye,
    squeeze,
    team_key,
    without_legal_form,
)
from .lookups import dealt_join
from .ordering import keep_one


# --- clubs -------------------------------------------------------------------------------------


def enrich_with_clubs(players: DataFrame, clubs: DataFrame) -> DataFrame:
    """Add ``club_name`` by trimmed club number; a number that occurs twice matches nothing."""
    number, name = squeeze(F.col("number")), squeeze(F.col("name"))
    known = clubs.where((number != "") & (name != ""))
    unique = (
        known.groupBy(number.alias("_no"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias("club_name"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
    return players.withColumn("_no", squeeze(F.col("club_no"))).join(
        unique, "_no", "left"
    ).drop("_no")


def club_aliases(clubs: DataFrame, spellings: DataFrame | None = None) -> DataFrame:
    """Alias keys of every club: its team key, the key without legal form, known spellings.

    ``spellings`` maps an ``alias`` text to the club ``name`` it stands for.
    """
    keyed = clubs.select("number", team_key(F.col("name")).alias("_key"))
    own = keyed.select(
        "number",
        F.explode(F.array(F.col("_key"), F.trim(without_legal_form(F.col("_key"))))).alias("alias"),
    )
    if spellings is not None:
        known = spellings.select(
            team_key(F.col("alias")).alias("alias"), team_key(F.col("name")).alias("_key")
        )
        own = own.unionByName(keyed.join(known, "_key").select("number", "alias"))
    return own.where(F.col("alias") != "").distinct()


def team_candidates(teams: DataFrame, aliases: DataFrame, team: str = "team") -> DataFrame:
    """Clubs whose alias is the team key, or the team key without a trailing team number.

    The two possible keys of a team make this an equi join instead of a prefix search.
    """
    names = teams.select(team).distinct().withColumn("team_key", team_key(F.col(team)))
    suffix = F.regexp_extract("team_key", r" (\d+)$", 1)
    numbered = F.when(
        suffix.try_cast("bigint") > 0,
        F.struct(
            F.regexp_replace("team_key", r" \d+$", "").alias("alias"),
            suffix.try_cast("bigint").alias("slot"),
        ),
    )
    exact = F.struct(F.col("team_key").alias("alias"), F.lit(1).cast("bigint").alias("slot"))
    keys = names.withColumn("_c", F.explode(F.array(exact, numbered))).where(
        F.col("_c").isNotNull()
    )
    return keys.select(team, "team_key", "_c.alias", "_c.slot").join(aliases, "alias")


def resolve_teams(
    teams: DataFrame, clubs: DataFrame, spellings: DataFrame | None = None, team: str = "team"
) -> DataFrame:
    """Club and slot of each team name, if exactly one fits; else a hashed fallback id."""
    names = teams.select(team).distinct()
    found = (
        team_candidates(names, club_aliases(clubs, spellings), team)
        .select(team, "number", "slot")
        .distinct()
        .groupBy(team)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("number", "slot")).alias("_c"))
        .where(F.col("_n") == 1)
    )
    out = names.withColumn("team_key", team_key(F.col(team))).join(found, team, "left")
    club_id = F.concat(
        F.lit("club-"), F.col("_c.number"), F.lit("-team-"), F.col("_c.slot").cast("string")
    )
    fallback = F.concat(F.lit("team-"), F.substring(F.sha2("team_key", 256), 1, 16))
    return out.select(
        team,
        "team_key",
        F.col("_c.number").alias("club_no"),
        F.col("_c.slot").alias("slot"),
        F.coalesce(club_id, fallback).alias("team_id"),
    )


def resolve_home_club(games: DataFrame, clubs: DataFrame, spellings: DataFrame | None = None) -> DataFrame:
    """Home club by the longest matching alias; ties between clubs give NULL."""
    aliases = clubs.select("number", club_alias(F.col("name")).alias("alias"))
    if spellings is not None:
        known = spellings.select(
            club_alias(F.col("alias")).alias("_as"), club_alias(F.col("name")).alias("alias")
        )
        aliases = aliases.unionByName(
            aliases.join(known, "alias").select("number", F.col("_as").alias("alias"))
        )
    homes = games.select(squeeze(F.col("home")).alias("_home")).distinct()
    found = team_candidates(homes, aliases.where(F.col("alias") != "").distinct(), "_home")
    size = F.length("alias")
    longest = found.groupBy("_home").agg(F.max(size).alias("_max"))
    best = (
        found.join(longest, "_home")
        .where(size == F.col("_max"))
        .groupBy("_home")
        .agg(F.min("number").alias("_lo"), F.max("number").alias("_hi"))
        .where(F.col("_lo") == F.col("_hi"))
        .select("_home", F.col("_lo").alias("home_club"))
    )
    return games.withColumn("_home", squeeze(F.col("home"))).join(best, "_home", "left").drop("_home")


# --- containment ---------------------------------------------------------------------------------

LONGEST = 64  # letters of a text whose substrings are listed, at most about 2,000


def _grams(text: Column, n: int | Column) -> Column:
    """Distinct substrings of length ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n))
    return F.when(last >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def containment_pairs(
    needles: DataFrame, texts: DataFrame, n: int, shorter: bool = False
) -> DataFrame:
    """All ``(needle, text)`` with the needle inside the text, for needles of at least ``n`` letters.

    ``shorter`` adds the needles of 1 to n-1 letters, which are whole pieces of a text.

    A text can only contain a needle if it has all of the needle's ``n``-letter pieces, so each
    needle is looked up by the one of its pieces that the fewest texts have. Exact, and an equi
    join; both inputs are distinct keys.
    """
    pieces = texts.select("text").distinct().select("text", F.explode(_grams(F.col("text"), n)).alias("_g"))
    spread = pieces.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    keys = needles.select("needle").distinct().where(F.length("needle") >= n)
    rarest = (
        keys.select("needle", F.explode(_grams(F.col("needle"), n)).alias("_g"))
        .join(spread, "_g", "left")
        .groupBy("needle")
        .agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    )
    out = (
        rarest.join(pieces, "_g")
        .where(F.col("text").contains(F.col("needle")))
        .select("needle", "text")
    )
    if shorter and n > 1:
        text = F.col("text")
        sizes = F.flatten(F.array(*[_grams(text, size) for size in range(1, n)]))
        short = needles.select("needle").distinct().where(F.length("needle").between(1, n - 1))
        small = texts.select("text").distinct().select("text", F.explode(sizes).alias("needle"))
        out = out.unionByName(short.join(small, "needle").select("needle", "text"))
    return out


def _substrings(df: DataFrame, text: str, name: str, likes: DataFrame, longest: int) -> DataFrame:
    """Rows of ``df`` with ``name``: each distinct substring of ``text`` (up to ``longest`` letters) that
    is as long as some text of the one column of ``likes``."""
    size = F.length(likes.columns[0])
    sizes = likes.where(size.between(1, longest)).agg(F.sort_array(F.collect_set(size))).scalar()
    rows = df.where(F.length(text) <= longest).withColumn("_size", F.explode(sizes))
    return rows.withColumn(name, F.explode(_grams(F.col(text), F.col("_size")))).drop("_size")


def first_containing(needles: DataFrame, options: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(key, first)``: the first option that contains the key, for every ``key`` of ``needles``.

    ``options`` has distinct ``option`` and ``first``, a value that orders them. Every substring of an
    option that has the length of some key is an entry of a dictionary that holds the best option
    of each entry, combined before the shuffle. So a key costs one row, however many options contain
    it. Options of more than ``longest`` letters are looked up by pieces instead.
    """
    keys = needles.select("key").distinct().where(F.col("key") != "")
    entries = _substrings(options, "option", "key", keys, longest)
    best = entries.groupBy("key").agg(F.min("first").alias("first"))
    long = options.where(F.length("option") > longest)
    rest = containment_pairs(
        keys.select(F.col("key").alias("needle")), long.select(F.col("option").alias("text")), 3, True
    ).select(F.col("needle").alias("key"), F.col("text").alias("option"))
    found = keys.join(best, "key").unionByName(rest.join(long, "option").select("key", "first"))
    return found.groupBy("key").agg(F.min("first").alias("first"))


def first_contained(
    texts: DataFrame, options: DataFrame, longest: int = LONGEST, salts: int = 16
) -> DataFrame:
    """``(key, first)``: the first option that stands in the key, for every ``key`` of ``texts``.

    A key meets the options by its substrings, of which it has a bounded number. Short options stand in
    most keys, so their rows are dealt over ``salts`` places. Keys of more than ``longest`` letters are
    looked up by pieces instead.
    """
    keys = texts.select("key").distinct().where(F.col("key") != "")
    parts = _substrings(keys, "key", "option", options.select("option"), longest)
    found = dealt_join(parts, options, ["option"], ["key"], salts=salts).select("key", "first")
    long = keys.where(F.length("key") > longest)
    rest = containment_pairs(
        options.select(F.col("option").alias("needle")), long.select(F.col("key").alias("text")), 3, True
    ).select(F.col("text").alias("key"), F.col("needle").alias("option"))
    found = found.unionByName(rest.join(options, "option").select("key", "first"))
    return found.groupBy("key").agg(F.min("first").alias("first"))


def groups_containing(
    texts: DataFrame, by: Sequence[str], needles: DataFrame, longest: int = LONGEST
) -> DataFrame:
    """``(*by, needle)``: the groups with a ``text`` that contains the needle.

    The substrings of a group's texts are made distinct before they meet the needles, so a needle has
    one row a group and not one for every text it stands in.
    """
    keys = needles.select("needle").distinct().where(F.col("needle") != "")
    rows = texts.select(*by, "text").distinct()
    parts = _substrings(rows, "text", "needle", keys, longest).select(*by, "needle")
    found = parts.distinct().join(keys, "needle").select(*by, "needle")
    long = rows.where(F.length("text") > longest)
    rest = containment_pairs(keys, long, 4, True).join(long, "text").select(*by, "needle")
    return found.unionByName(rest).distinct()


def club_match(clubs: DataFrame, names: DataFrame) -> DataFrame:
    """``(club, target)`` pairs whose base names are equal or contain each other.

    The club base (six letters or more) may stand in the target, or the target base (eight or
    more) in the club. Scores and names under three letters never match.
    """
    plain = squeeze(F.col("target"))
    left = clubs.select("club", club_base_key(F.col("club")).alias("_c")).where(F.col("_c") != "")
    right = (
        names.where(~plain.rlike(r"^\d+([:.]\d+)?$") & (F.length(plain) >= 3))
        .select("target", club_base_key(F.col("target")).alias("_t"))
        .where(F.length("_t") >= 3)
    )
    left, right = left.distinct(), right.distinct()
    equal = left.select("_c").distinct().join(
        right.select("_t").distinct(), F.col("_c") == F.col("_t")
    )
    inside = containment_pairs(
        left.select(F.col("_c").alias("needle")), right.select(F.col("_t").alias("text")), 6
    ).select(F.col("needle").alias("_c"), F.col("text").alias("_t"))
    outside = containment_pairs(
        right.select(F.col("_t").alias("needle")), left.select(F.col("_c").alias("text")), 8
    ).select(F.col("text").alias("_c"), F.col("needle").alias("_t"))
    keys = equal.unionByName(inside).unionByName(outside).distinct()
    return keys.join(left, "_c").join(right, "_t").select("club", "target")


def strict_contains_match(a: Column, b: Column) -> Column:
    """One name contains the other and the rest is not just a number."""

    def inside(long: Column, short: Column) -> Column:
        at = F.instr(long, short)
        rest = F.trim(
            F.concat(
                F.substring(long, F.lit(1), at - 1),
                F.substring(long, at + F.length(short), F.length(long)),
            )
        )
        return long.contains(short) & ~rest.rlike(r"^\d+$")

    return (a == b) | F.when(a.contains(b), inside(a, b)).otherwise(inside(b, a))


def letters_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def exact_then_fuzzy(left: DataFrame, right: DataFrame, longest: int = LONGEST) -> DataFrame:
    """For each ``name`` of ``left``: the equal name of ``right``, else the first that contains it
    or is contained in it. ``right`` has ``candidate`` and ``position``; of equal positions the
    smallest candidate is first.

    Keys of any length match by containment. No pairs are listed: a name gets one row from the
    candidates that contain it, and one from those that it contains.
    """
    names = left.select("name").distinct().withColumn("_k", letters_key(F.col("name")))
    options = right.select("candidate", "position", letters_key(F.col("candidate")).alias("_r"))
    rank = F.struct("position", "candidate")
    options = keep_one(options.where(F.col("_r") != ""), ["_r"], rank)
    exact = names.where(F.col("_k") != "").join(options, F.col("_k") == F.col("_r")).select(
        "name", F.col("candidate").alias("_exact")
    )
    keys = names.select(F.col("_k").alias("key"))
    ranked = options.select(F.col("_r").alias("option"), rank.alias("first"))
    first = (
        first_containing(keys, ranked, longest)
        .unionByName(first_contained(keys, ranked, longest))
        .groupBy(F.col("key").alias("_k"))
        .agg(F.min("first")["candidate"].alias("_fuzzy"))
    )
    resolved = names.join(exact, "name", "left").join(first, "_k", "left").select(
        "name",
        F.coalesce("_exact", "_fuzzy").alias("candidate"),
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_fuzzy").isNotNull(), "contains")
        .otherwise("none")
        .alias("match"),
    )
    return left.join(resolved, "name", "left")


# --- people ---------------------------------------------------------------------------------------


def link_history(players: DataFrame, history: DataFrame) -> DataFrame:
    """History id of each current player by id, else by case-folded name (smallest id first).

    ``history`` has one row per ``history_id`` and ``name``.
    """
    ids = history.select(F.col("history_id").alias("_id")).distinct()
    by_name = (
        history.groupBy(F.lower("name").alias("_name")).agg(F.min("history_id").alias("_by_name"))
    )
    linked = players.join(ids, F.col("player_id") == F.col("_id"), "left")
    linked = linked.withColumn("_name", F.lower("name")).join(by_name, "_name", "left")
    return linked.select(
        *players.columns,
        F.coalesce("_id", "_by_name").alias("history_id"),
        F.when(F.col("_id").isNotNull(), "id")
        .when(F.col("_by_name").isNotNull(), "name")
        .otherwise("none")
        .alias("linked_by"),
    )


def resolve_person(saved: DataFrame, people: DataFrame) -> DataFrame:
    """Status of saved people against ranking rows: resolved, ambiguous, missing or invalid.

    ``saved``: saved_id, person_key, record_key, and ``name_key`` for old entries that only know
    a name. ``people``: person_key, record_key, name_key, one row per ranking row. A name resolves
    only if one person with one record has it.
    """
    records = people.groupBy("person_key", "record_key").agg(F.count(F.lit(1)).alias("_records"))
    persons = people.select("person_key").distinct().withColumn("_person", F.lit(True))
    names = people.groupBy(F.col("name_key").alias("_n")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("person_key").alias("_p"),
        F.min("record_key").alias("_r"),
    )
    keyed = saved.where(F.col("person_key").isNotNull()).join(
        records, ["person_key", "record_key"], "left"
    ).join(persons, "person_key", "left")
    by_key = keyed.select(
        "saved_id",
        F.when(F.col("record_key").isNull(), "invalid")
        .when(F.col("_person").isNull() | F.col("_records").isNull(), "missing")
        .when(F.col("_records") > 1, "ambiguous")
        .otherwise("resolved")
        .alias("status"),
        F.when(F.col("_records") == 1, F.col("record_key")).alias("resolved_key"),
    )
    legacy = saved.where(F.col("person_key").isNull()).join(
        names, (F.col("name_key") == F.col("_n")) & (F.col("name_key") != ""), "left"
    )
    by_name = legacy.select(
        "saved_id",
        F.when(F.col("_rows").isNull(), "missing")
        .when(F.col("_rows") > 1, "ambiguous")
        .when(F.col("_p").isNull() | F.col("_r").isNull(), "invalid")
        .otherwise("resolved")
        .alias("status"),
        F.when(F.col("_rows") == 1, F.col("_r")).alias("resolved_key"),
    )
    return by_key.unionByName(by_name)


def resolve_feed(teams: DataFrame, index: DataFrame, team: str = "team") -> DataFrame:
    """Feed of each team name by key; a key that points to two teams resolves nothing.

    ``index``: alias key ``key`` and ``team_id``, see ``feed_keys``.
    """
    unique = (
        index.groupBy("key")
        .agg(F.min("team_id").alias("_lo"), F.max("team_id").alias("_hi"))
        .select("key", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("feed"))
    )
    return teams.withColumn("key", team_key(F.col(team))).join(unique, "key", "left").drop("key")


def feed_keys(teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keys of resolved teams: own key, every alias with the slot, the bare alias for slot 1."""
    own = teams.select(F.col("team_key").alias("key"), "team_id")
    joined = teams.select("team_id", "slot", F.col("club_no").alias("number")).distinct().join(
        aliases, "number"
    )
    numbered = joined.select(
        F.concat_ws(" ", "alias", F.col("slot").cast("string")).alias("key"), "team_id"
    )
    bare = joined.where(F.col("slot") == 1).select(F.col("alias").alias("key"), "team_id")
    return own.unionByName(numbered).unionByName(bare).distinct()


# --- team mapping -----------------------------------------------------------------------------------


def team_mapping(clubs: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Mapping of exact team labels to ``(club_no, team_id)``.

    ``clubs``: club_no, label. ``teams``: club_no, label, team_id (NULL = no id of its own). A club
    without team rows maps its own label. Clubs with an invalid number, a missing label or two
    labels are dropped; ``multi_team`` marks clubs with several teams and ``ambiguous`` labels that
    point to more than one team.
    """
    checked = clubs.groupBy("club_no").agg(
        F.min("label").alias("_lo"),
        F.max("label").alias("_hi"),
        F.bool_or(F.col("label").isNull()).alias("_bad"),
    )
    good = checked.where(
        F.col("club_no").rlike("^[0-9]+$") & ~F.col("_bad") & (F.col("_lo") == F.col("_hi"))
    ).select("club_no", F.col("_lo").alias("_club_label"))
    own = good.select(
        "club_no", F.col("_club_label").alias("label"), F.col("club_no").alias("team_id"),
        F.lit(False).alias("has_team_id"),
    )
    rows = own
    if teams is not None:
        bad = teams.where(F.col("label").isNull()).select("club_no").distinct()
        listed = teams.join(good, "club_no", "left_semi").select(
            "club_no", "label", F.coalesce("team_id", "label").alias("team_id"),
            F.col("team_id").isNotNull().alias("has_team_id"),
        )
        named = teams.select("club_no").distinct()
        rows = (
            own.join(named, "club_no", "left_anti")
            .unionByName(listed)
            .join(bad, "club_no", "left_anti")
        )
    rows = rows.distinct()
    per_club = rows.groupBy("club_no").agg((F.count(F.lit(1)) > 1).alias("multi_team"))
    per_label = rows.groupBy("label").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return rows.join(per_club, "club_no").join(per_label, "label")


def map_match_teams(matches: DataFrame, mapping: DataFrame) -> DataFrame:
    """Clubs and teams of both sides, with a reason when a side is not exactly one team.

    ``matches`` has ``home_label`` and ``away_label``.
    """
    unique = mapping.where(~F.col("ambiguous"))

    def side(prefix: str) -> DataFrame:
        return unique.select(
            F.col("label").alias(f"{prefix}_label"),
            F.col("club_no").alias(f"{prefix}_club"),
            F.col("team_id").alias(f"{prefix}_team"),
            F.col("multi_team").alias(f"{prefix}_multi"),
        )

    out = matches.join(side("home"), "home_label", "left").join(side("away"), "away_label", "left")
    bad = (
        F.col("home_team").isNull()
        | F.col("away_team").isNull()
        | (
            (F.col("home_club") == F.col("away_club"))
            & (F.col("home_team") == F.col("away_team"))
        )
    )
    return out.withColumn("reason", F.when(bad, "teamMapping"))


def preview_teams(players: DataFrame, table_teams: DataFrame, clubs: DataFrame) -> DataFrame:
    """Teams of ranking players and league tables, one row per id.

    ``players``: club_no, company, position. A player's club gives the first name, shown as the
    table spells it (equal letters, else the first containment); table teams without a player
    follow under their club number or ``NAME:`` id.
    """
    named = keep_one(clubs.where(F.col("number").isNotNull()), ["number"], F.col("position"))
    named = named.select(F.col("number").alias("_no"), F.col("name").alias("_club_name"))
    number = F.nullif(squeeze(F.col("club_no")), F.lit(""))
    company = F.nullif(squeeze(F.col("company")), F.lit(""))
    listed = players.withColumn("_no", number).join(named, "_no", "left").select(
        F.coalesce("_no", F.concat(F.lit("NAME:"), company)).alias("id"),
        F.coalesce("_club_name", company).alias("name"),
        "position",
    ).where(F.col("id").isNotNull() & F.col("name").isNotNull())
    first = keep_one(listed, ["id"], F.col("position"))
    tables = table_teams.select(squeeze(F.col("team")).alias("candidate"), "position").where(
        (F.col("candidate") != "")
        & ~F.lower("candidate").isin("tabelle", "team", "mannschaft")  # fixed: header words
        & ~is_bye(F.col("candidate"))
    )
    spelled = exact_then_fuzzy(first, tables).select(
        "id", F.coalesce("candidate", "name").alias("name")
    )
    known = spelled.select(letters_key(F.col("name")).alias("_k")).distinct()
    rest = keep_one(
        tables.withColumn("_k", letters_key(F.col("candidate"))).where(F.col("_k") != ""),
        ["_k"], F.col("position"), ["candidate", "_k", "position"],
    ).join(known, "_k", "left_anti")
    by_name = keep_one(
        clubs.select(
            letters_key(F.col("name")).alias("_k"), F.col("number").alias("_no"), "position"
        ), ["_k"], F.col("position"),
    ).drop("position")
    extra = rest.join(by_name, "_k", "left").select(
        F.coalesce(
            F.nullif(squeeze(F.col("_no")), F.lit("")), F.concat(F.lit("NAME:"), F.col("candidate"))
        ).alias("id"),
        F.col("candidate").alias("name"),
        "position",
    )
    extra = keep_one(extra, ["id"], F.col("position")).drop("position")
    return spelled.unionByName(extra.join(spelled, "id", "left_anti"))


# --- search -----------------------------------------------------------------------------------------


def filter_clubs(clubs: DataFrame, query: Column, search: str = "search_text") -> DataFrame:
    """Clubs whose stored search key contains the query key; a blank query keeps all."""
    return clubs.where((query == "") | F.col(search).contains(query))


def search(entries: DataFrame, query: str, k: int = 10) -> DataFrame:
    """First ``k`` index entries ``(kind, key, name, position)`` that contain the query.

    Queries under two characters find nothing.
    """
    needle = query.strip().lower()
    hits = entries.where(F.lower("name").contains(needle) & F.lit(len(needle) >= 2))
    return hits.orderBy("position").limit(k)


def search_index(leagues: DataFrame, clubs: DataFrame, people: DataFrame) -> DataFrame:
    """One list of leagues, clubs and people in that order; each input has key and name."""
    out = None
    for n, (kind, df) in enumerate((("league", leagues), ("club", clubs), ("person", people))):
        part = df.select(
            F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "name",
            F.struct(F.lit(n).alias("kind_no"), F.col("key").alias("key")).alias("position"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
