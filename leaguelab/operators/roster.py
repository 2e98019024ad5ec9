"""Team rosters and line-ups for many teams at once.

``teams``: team_id, club_no, label, multi_team, cutoff (start year of the target season),
target_ord. ``current``: rows of ``current_players``. History tables as in ``calibration``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import confidence_name, confidence_ordinal, evidence_ordinal, safe_rating
from ..functions.classes import league_class
from ..functions.fingerprint import fingerprint
from ..functions.seasons import canonical_season, season_in_label
from .calibration import NEUTRAL_RATING, PRIOR_APPEARANCES
from .lookups import dealt_join, lookup
from .ordering import top_k

LINEUP = 4  # fixed value: players of a line-up


def current_players(
    players: DataFrame, dataset_season: str | None, target_season: str | None, normalized: bool = False
) -> DataFrame:
    """Current ranking rows reconciled with the season they are used for.

    ``players``: player_id, name, name_key, club_no, league, season (may be NULL), team_label,
    points, appearances. ``status`` of an id is ``usable``, ``irrelevant`` (another season) or
    ``ambiguous`` (invalid or conflicting rows); usable ids have one row.
    """
    null = F.lit(None).cast("string")
    data = F.lit(dataset_season) if dataset_season else null
    target = F.lit(target_season) if target_season else null
    rows = players.withColumn("class", league_class(F.col("league"), normalized))
    rows = rows.withColumn("_in_league", season_in_label(F.col("league"))["key"])
    rows = rows.withColumn("_own", canonical_season(F.col("season"))["key"])
    league, own = F.col("_in_league"), F.col("_own")
    signal = F.col("league").rlike(
        r"(?i)saison|\b(?:[0-9]{2}|[0-9]{4})\s*[/\-]\s*(?:[0-9]{2}|[0-9]{4})\b"
    )
    invalid = (
        (F.col("season").isNotNull() & own.isNull())
        | (F.coalesce(signal, F.lit(False)) & (F.col("class").isNull() | league.isNull()))
        | F.coalesce(own != league, F.lit(False))
        | F.coalesce((own != data) | (league != data), F.lit(False))
        | F.coalesce((own != data), F.lit(False))
        | F.coalesce((league != data), F.lit(False))
    )
    none = own.isNull() & league.isNull()
    stale = (
        F.coalesce(data != target, F.lit(False))
        | (
            data.isNull()
            & target.isNotNull()
            & ~none
            & ~F.coalesce(own == target, F.lit(False))
            & ~F.coalesce(league == target, F.lit(False))
        )
        | (none & data.isNull())
    )
    broken = (
        ~F.coalesce(F.col("player_id").cast("string").rlike("^[0-9]+$"), F.lit(False))
        | F.col("name").isNull()
        | ~F.coalesce(F.col("club_no").rlike("^[0-9]+$"), F.lit(False))
    )
    reason = (
        F.when(invalid, "invalidSeason").when(stale, "irrelevantSeason").when(broken, "malformed")
    )
    content = ["name_key", "club_no", "class", "team_label", "points", "appearances"]
    marked = rows.withColumn("_reason", reason).withColumn("_print", fingerprint(*content))
    per_id = marked.groupBy("player_id").agg(
        F.bool_or(F.col("_reason").isin("invalidSeason", "malformed")).alias("_invalid"),
        F.bool_and(F.col("_reason") == "irrelevantSeason").alias("_irrelevant"),
        F.min(F.when(F.col("_reason").isNull(), F.col("_print"))).alias("_lo"),
        F.max(F.when(F.col("_reason").isNull(), F.col("_print"))).alias("_hi"),
        F.min_by(F.struct("name", *content), F.when(F.col("_reason").isNull(), F.col("_print"))).alias("_row"),
    )
    status = (
        F.when(F.coalesce("_invalid", F.lit(False)), "ambiguous")
        .when(F.col("_lo") != F.col("_hi"), "ambiguous")
        .when(F.col("_lo").isNull(), "irrelevant")
        .otherwise("usable")
    )
    return per_id.select("player_id", status.alias("status"), "_row.*")


def absent_from_season(candidates: DataFrame, seasons: DataFrame) -> DataFrame:
    """Candidates ``(player_id, cutoff)`` without any record in the newest season of the cutoff."""
    return candidates.join(seasons, ["player_id", "cutoff"], "left_anti")


def veto_roster(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Historical candidates that no current row claims: neither usable nor ambiguous ids.

    A usable id is on its current team already, or affiliated elsewhere.
    """
    claimed = current.where(F.col("status") != "irrelevant").select("player_id")
    return candidates.join(claimed, "player_id", "left_anti")


def newest_seasons(history: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The two newest history seasons with a club before each cutoff (``age`` 1 and 2)."""
    seasons = history.where(F.col("club_no").isNotNull()).select("season_start", "season_end").distinct()
    years = cutoffs.select("cutoff").distinct()
    # Both sides hold one row per season, whatever the number of players.
    usable = seasons.withColumn(
        "cutoff", F.explode(years.agg(F.sort_array(F.collect_set("cutoff"))).scalar())
    ).where(F.col("season_end") <= F.col("cutoff"))
    order = [F.col("season_end").desc(), F.col("season_start").desc()]
    return top_k(usable, ["cutoff"], order, 2, "age").select("cutoff", "season_start", "age")


def season_ages(history: DataFrame, teams: DataFrame) -> Callable[..., Column]:
    """Lookup of a season's ``(cutoff, age)`` pairs, NULL for seasons that are too old everywhere."""
    recent = newest_seasons(history, teams).groupBy("season_start").agg(
        F.collect_list(F.struct("cutoff", "age")).alias("_ages")
    )
    return lookup(recent, ["season_start"], F.col("_ages"))


def historical_candidates(teams: DataFrame, history: DataFrame) -> DataFrame:
    """Players whose last affiliation in one of the two newest seasons fits a team's club and class.

    ``history`` are segments with ``ambiguous`` and optionally ``team_label``. ``age`` is 1 for the
    newest season. Only segments of those seasons move, once, by player and season; a player's
    segments of a season are few. Teams are copied, since a club may hold most of the players.
    """
    season = ["player_id", "season_start"]
    rows = history.where(~F.col("ambiguous"))
    if "team_label" not in rows.columns:
        rows = rows.withColumn("team_label", F.lit(None).cast("string"))
    segment = ["club_no", "class_ord", "team_label", "last_round", "segment_id", "name"]
    held = (
        rows.withColumn("_ages", season_ages(history, teams)("season_start"))
        .where(F.col("_ages").isNotNull())
        .groupBy(*season)
        .agg(F.collect_list(F.struct(*segment)).alias("_all"), F.first("_ages").alias("_ages"))
    )
    latest = F.array_max(F.transform("_all", lambda s: s["last_round"]))
    held = held.withColumn("_latest", latest).where(F.col("_latest") >= 0).withColumn(
        "_all", F.filter("_all", lambda s: s["last_round"] == F.col("_latest"))
    )
    # The affiliation of a season: all segments of its greatest round name one club.
    clubs = F.array_distinct(F.transform("_all", lambda s: s["club_no"]))
    fits = (
        held.where((F.size(clubs) == 1) & F.element_at(clubs, 1).isNotNull())
        .select(*season, "_ages", F.explode("_all").alias("_s"))
        .select(*season, "_ages", "_s.*")
        .groupBy(*season, "club_no", "class_ord", "team_label")
        .agg(F.min_by("name", "segment_id").alias("name"), F.first("_ages").alias("_ages"))
        .withColumn("_a", F.explode("_ages"))
        .select("player_id", "club_no", "class_ord", "team_label", "name", "_a.cutoff", "_a.age")
    )
    few = teams.withColumnRenamed("target_ord", "class_ord")
    joined = dealt_join(fits, few, ["club_no", "class_ord", "cutoff"], ["player_id"])
    label_ok = ~F.col("multi_team") | F.coalesce(F.col("team_label") == F.col("label"), F.lit(False))
    return (
        joined.where(label_ok)
        .groupBy("team_id", "cutoff", F.col("class_ord").alias("target_ord"), "player_id", "age")
        .agg(F.min("name").alias("name"))
    )


def roster_order() -> list[Column]:
    """Evidence, rating, id."""
    return [evidence_ordinal(F.col("evidence")), F.col("rating").desc(), F.col("player_id")]


def order_roster(roster: DataFrame) -> DataFrame:
    return roster.orderBy("team_id", *roster_order())


def roster_targets(teams: DataFrame, current: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(player_id, cutoff, target_ord)`` for which the roster needs a prior."""
    mine = _selected(teams, current).select("player_id", "cutoff", "target_ord")
    return mine.unionByName(candidates.select("player_id", "cutoff", "target_ord")).distinct()


def _selected(teams: DataFrame, current: DataFrame) -> DataFrame:
    usable = current.where(F.col("status") == "usable")
    label_ok = ~F.col("multi_team") | F.coalesce(F.col("team_label") == F.col("label"), F.lit(False))
    few = teams.withColumnRenamed("target_ord", "class_ord")
    return dealt_join(usable, few, ["club_no", "class_ord"], ["player_id"]).where(label_ok).select(
        "team_id", "cutoff", F.col("class_ord").alias("target_ord"), "player_id", "name", "name_key",
        "points", "appearances",
    )


def team_roster(
    teams: DataFrame,
    current: DataFrame,
    candidates: DataFrame,
    history: DataFrame,
    priors: DataFrame,
    name_key: Column | None = None,
) -> DataFrame:
    """Roster of every team: current players, then last season's, then older ones up to four.

    ``candidates`` is ``historical_candidates``; ``priors`` covers ``roster_targets``;
    ``current`` needs ``class_ord``. Current results blend with the prior of four appearances. A
    prior does not count when the player's history has another name.
    """
    keys = ["player_id", "cutoff", "target_ord"]
    key = F.lower("name") if name_key is None else name_key
    names = history.withColumn("_k", key).groupBy("player_id").agg(
        F.min("_k").alias("_lo"), F.max("_k").alias("_hi")
    )
    mine = (
        _selected(teams, current)
        .join(priors, keys, "left")
        .join(names, "player_id", "left")
        .withColumn(
            "_same",
            F.col("_lo").isNull()
            | ((F.col("_lo") == F.col("name_key")) & (F.col("_hi") == F.col("name_key"))),
        )
    )
    known = F.col("_same") & (F.coalesce("prior_seasons", F.lit(0)) > 0)
    mean = F.coalesce("target_mean", F.lit(NEUTRAL_RATING))
    mine = mine.withColumn("_known", known).withColumn(
        "_prior", F.when(F.col("_same"), F.coalesce("prior", mean)).otherwise(mean)
    )
    blended = safe_rating(
        F.when(
            F.col("appearances") > 0,
            (F.col("points") + PRIOR_APPEARANCES * F.col("_prior"))
            / (F.col("appearances") + PRIOR_APPEARANCES),
        ).otherwise(F.col("_prior"))
    )
    mine = mine.withColumn("_blend", blended)
    weak = F.col("_blend").isNull() | (F.col("_known") & ~F.col("class_calibrated"))
    confidence = (
        F.when(weak, "very-low")
        .when(F.col("appearances") >= 8, "high")
        .when((F.col("appearances") >= 1) & F.col("_known"), "medium")
        .when((F.col("appearances") >= 1) | F.col("_known"), "provisional")
        .otherwise("very-low")
    )
    columns = ["team_id", "cutoff", "target_ord", "player_id", "name"]
    first = mine.select(
        *columns,
        F.coalesce("_blend", mean).alias("rating"),
        F.when(F.col("_known"), "current+history").otherwise("current").alias("evidence"),
        confidence.alias("confidence"),
        F.lit(False).alias("unconfirmed"),
    )
    free = veto_roster(candidates, current).join(priors, keys).where(F.col("prior_seasons") > 0)
    newest = free.where(F.col("age") == 1)
    second = newest.select(
        *columns,
        F.col("prior").alias("rating"),
        F.lit("historical").alias("evidence"),
        F.when(F.col("confidence") == "very-low", "very-low").otherwise("provisional").alias("confidence"),
        F.lit(True).alias("unconfirmed"),
    )
    seen = (
        history.select("player_id", season_ages(history, teams)("season_start").alias("_ages"))
        .withColumn("_a", F.explode("_ages"))
        .where(F.col("_a.age") == 1)
        .select("player_id", "_a.cutoff")
        .distinct()
    )
    older = absent_from_season(free.where(F.col("age") == 2), seen).select(
        *columns,
        F.col("prior").alias("rating"),
        F.lit("historical-fallback").alias("evidence"),
        F.lit("very-low").alias("confidence"),
        F.lit(True).alias("unconfirmed"),
    )
    roster = first.unionByName(second)
    sizes = roster.groupBy("team_id", "cutoff", "target_ord").agg(F.count(F.lit(1)).alias("_n"))
    team_keys = ["team_id", "cutoff", "target_ord"]
    third = (
        top_k(older, team_keys, [F.col("rating").desc(), "player_id"], LINEUP, "_place")
        .join(sizes, team_keys, "left")
        .where(F.col("_place") <= LINEUP - F.coalesce("_n", F.lit(0)))
    )
    return roster.unionByName(third.select(*roster.columns))


def best_four(roster: DataFrame, by: list[str], rating: str = "rating", position: str = "position"):
    """Best four positive ratings of each team, first in source on ties, and their sum over four."""
    best = top_k(
        roster.where(F.col(rating) > 0), by, [F.col(rating).desc(), F.col(position)], LINEUP, "slot"
    )
    return best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("players"), (F.sum(rating) / LINEUP).alias("mean")
    )


def complete_lineup(roster: DataFrame, teams: DataFrame) -> DataFrame:
    """Four slots per team as an array, filled up with neutral players of the class mean.

    ``teams``: team_id, cutoff, target_ord, class_mean (NULL = none). Two or more neutral slots
    make the team very-low.
    """
    keys = ["team_id", "cutoff", "target_ord"]
    usable = roster.where(safe_rating(F.col("rating")).isNotNull())
    slot = F.struct(
        F.col("slot"), F.col("player_id").cast("string").alias("player_id"), F.col("rating"),
        F.col("evidence"), F.col("confidence"), F.col("unconfirmed"),
    )
    chosen = (
        top_k(usable, keys, roster_order(), LINEUP, "slot")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(slot)).alias("_known"))
    )
    mean = F.coalesce(safe_rating(F.col("class_mean")), F.lit(NEUTRAL_RATING))
    joined = teams.join(chosen, keys, "left").withColumn(
        "_known", F.coalesce("_known", F.array().cast(chosen.schema["_known"].dataType))
    )

    def neutral(i: Column) -> Column:
        number = i - F.size("_known")
        return F.struct(
            i.alias("slot"),
            F.concat(F.lit("neutral-"), number.cast("string")).alias("player_id"),
            mean.alias("rating"),
            F.lit("neutral").alias("evidence"),
            F.lit("very-low").alias("confidence"),
            F.lit(True).alias("unconfirmed"),
        )

    slots = F.transform(
        F.sequence(F.lit(1), F.lit(LINEUP)),
        lambda i: F.when(i <= F.size("_known"), F.get("_known", i - 1)).otherwise(neutral(i)),
    )
    out = joined.withColumn("slots", slots)
    worst = F.array_max(F.transform("slots", lambda s: confidence_ordinal(s["confidence"])))
    return out.select(
        *teams.columns,
        "slots",
        F.when(F.size("_known") <= LINEUP - 2, "very-low")
        .otherwise(confidence_name(worst))
        .alias("team_confidence"),
    )


# Uncertainty of a slot by confidence, and what weak evidence adds.
SLOT_UNCERTAINTY = {"high": 0.04, "medium": 0.10, "provisional": 0.20, "very-low": 0.32}
NEUTRAL_UNCERTAINTY, UNCONFIRMED_UNCERTAINTY, INVALID_UNCERTAINTY = 0.18, 0.04, 0.5


def lineup_summary(slots: DataFrame, by: list[str]) -> DataFrame:
    """Mean rating, weakest confidence and mean uncertainty of each line-up.

    Only a line-up of exactly four rated slots is valid. Slots: rating, confidence, evidence,
    unconfirmed.
    """
    level = F.lit(SLOT_UNCERTAINTY["very-low"])
    for name, value in SLOT_UNCERTAINTY.items():
        level = F.when(F.col("confidence") == name, F.lit(value)).otherwise(level)
    doubt = (
        level
        + F.when(evidence_ordinal(F.col("evidence")) == 4, NEUTRAL_UNCERTAINTY).otherwise(0.0)
        + F.when(F.coalesce("unconfirmed", F.lit(False)), UNCONFIRMED_UNCERTAINTY).otherwise(0.0)
    )
    rating = safe_rating(F.col("rating"))
    out = slots.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(rating).alias("_rated"),
        F.avg(rating).alias("_score"),
        F.max(confidence_ordinal(F.col("confidence"))).alias("_worst"),
        F.avg(doubt).alias("_doubt"),
    )
    valid = (F.col("_n") == LINEUP) & (F.col("_rated") == LINEUP)
    return out.select(
        *by,
        valid.alias("valid"),
        F.when(valid, F.col("_score")).otherwise(NEUTRAL_RATING).alias("score"),
        F.when(valid, confidence_name(F.col("_worst"))).otherwise("very-low").alias("confidence"),
        F.when(valid, F.col("_doubt")).otherwise(INVALID_UNCERTAINTY).alias("uncertainty"),
    )
