"""Team event state: events from fixtures, idempotent merges, index, incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from .ordering import with_position

# The attributes an event's fingerprint covers, in this order.
CONTENT = [
    "uid", "season", "league", "round_name", "team_id", "team_name", "opponent", "home_team",
    "away_team", "is_home", "starts_at", "location", "location_warning", "status",
]
STATE = [*CONTENT, "fingerprint", "sequence", "last_modified"]
CONFIRMED, CANCELLED = "CONFIRMED", "CANCELLED"


def event_uid(season: Column, league: Column, round_name: Column, team_id: Column) -> Column:
    """Stable id of a team's event in a round."""
    return F.sha2(F.concat_ws("\x1f", season, league, round_name, team_id), 256)


def event_fingerprint() -> Column:
    return fingerprint(*CONTENT)


def team_events(fixtures: DataFrame, teams: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One confirmed event per resolved team of each fixture.

    ``fixtures``: season, league, round_name, home, away, starts_at, location, location_warning, and
    the columns of ``keep``, which the events have too. ``teams``: team, team_id of resolved teams only.
    """
    side = lambda team, other, home: F.struct(
        F.col(team).alias("team_name"), F.col(other).alias("opponent"), F.lit(home).alias("is_home")
    )
    rows = fixtures.withColumn(
        "_s", F.explode(F.array(side("home", "away", True), side("away", "home", False)))
    )
    rows = rows.select(
        "season", "league", "round_name", "_s.*", F.col("home").alias("home_team"),
        F.col("away").alias("away_team"), "starts_at", "location", "location_warning", *keep,
    )
    known = teams.where(F.col("team_id").rlike(r"^club-[0-9]+-team-[0-9]+$")).select(
        F.col("team").alias("team_name"), "team_id"
    )
    events = rows.join(known, "team_name").withColumn("status", F.lit(CONFIRMED))
    uid = event_uid(F.col("season"), F.col("league"), F.col("round_name"), F.col("team_id"))
    return events.withColumn("uid", uid).withColumn("fingerprint", event_fingerprint()).select(
        *CONTENT, "fingerprint", *keep
    )


def merge_state(previous: DataFrame, events: DataFrame, season: Column, now: Column) -> DataFrame:
    """Merge the current events into the previous state.

    Unchanged events keep sequence and time; new ones start at 0; changed ones count up; missing
    ones become cancelled once. Previous events of another season are dropped, not cancelled.
    Applying the same events again changes nothing.
    """
    prior = previous.where(F.col("season") == season)
    p = prior.select(*[F.col(c).alias(f"p_{c}") for c in STATE], F.lit(True).alias("_p"))
    e = events.select(*[F.col(c).alias(f"e_{c}") for c in [*CONTENT, "fingerprint"]])
    joined = p.join(e, F.col("p_uid") == F.col("e_uid"), "full_outer")
    gone = F.col("e_uid").isNull()
    kept = (F.col("p_fingerprint") == F.col("e_fingerprint")) & ~gone
    frozen = gone & (F.col("p_status") == CANCELLED)
    same = F.coalesce(kept | frozen, F.lit(False))
    content = [
        F.coalesce(F.when(gone, F.lit(CANCELLED)), F.col("e_status")).alias(c)
        if c == "status"
        else F.when(gone, F.col(f"p_{c}")).otherwise(F.col(f"e_{c}")).alias(c)
        for c in CONTENT
    ]
    merged = joined.select(
        *content,
        F.when(F.col("_p").isNull(), 0)
        .when(same, F.col("p_sequence"))
        .otherwise(F.col("p_sequence") + 1)
        .cast("int")
        .alias("sequence"),
        F.when(same, F.col("p_last_modified")).otherwise(now).alias("last_modified"),
    )
    return merged.withColumn("fingerprint", event_fingerprint()).select(*STATE)


def feed_teams(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Resolved teams with a readable game, timed or not; the smallest key and name per id."""
    named = fixtures.where(F.col("classification").isin("game", "missing_time")).select(
        F.explode(F.array("home", "away")).alias("team")
    ).distinct()
    known = teams.where(F.col("club_no").isNotNull())
    return (
        named.join(known, "team")
        .groupBy("team_id")
        .agg(F.min(F.struct("team_key", "team")).alias("_t"))
        .select("team_id", F.col("_t.team_key").alias("team_key"), F.col("_t.team").alias("team"))
    )


def future_events(state: DataFrame, now: Column) -> DataFrame:
    """Confirmed events from now on."""
    return state.where((F.col("status") == CONFIRMED) & (F.col("starts_at") >= now))


def event_index(state: DataFrame, teams: DataFrame) -> DataFrame:
    """Events and warnings of every feed team, also those without events.

    The name is that of the first confirmed event by uid, else of the first event.
    """
    first = F.struct((F.col("status") != CONFIRMED).cast("int"), F.col("uid"))
    counts = state.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("location_warning").isNotNull()).alias("warnings"),
        F.min_by("team_name", first).alias("_name"),
    )
    zero = F.lit(0).cast("bigint")
    return teams.join(counts, "team_id", "full_outer").select(
        "team_id",
        F.coalesce("_name", "team").alias("name"),
        F.coalesce("events", zero).alias("events"),
        F.coalesce("warnings", zero).alias("warnings"),
    )


def check_state(state: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows that break the state contract, with their reasons and the columns of ``keep``.

    The uid and the fingerprint are recomputed; uids are unique and one season is used. What a row
    itself breaks is found where it is, so only that moves, by uid. Rows meet the counts of their uids
    by a merge: both grow with the state, and Spark takes written hashes for smaller than they are.
    """
    uid = event_uid(F.col("season"), F.col("league"), F.col("round_name"), F.col("team_id"))
    own = {
        "uid": F.col("uid") == uid,
        "fingerprint": F.col("fingerprint") == event_fingerprint(),
        "status": F.col("status").isin(CONFIRMED, CANCELLED),
        "sequence": F.col("sequence") >= 0,
    }
    rows = state.select(
        "uid", "team_id", *keep,
        *[F.coalesce(ok, F.lit(False)).alias(f"_{name}") for name, ok in own.items()],
    )
    twice = state.groupBy("uid").agg((F.count(F.lit(1)) > 1).alias("_twice")).where("_twice")
    seasons = state.agg(F.count_distinct("season")).scalar()
    checked = rows.join(twice.hint("merge"), "uid", "left").withColumn("_seasons", seasons)
    checks = [
        (F.col("_uid"), "uid"),
        (F.col("_fingerprint"), "fingerprint"),
        (F.col("_twice").isNull(), "duplicate uid"),
        (F.col("_seasons") == 1, "several seasons"),
        (F.col("_status"), "status"),
        (F.col("_sequence"), "sequence"),
    ]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for ok, text in checks]))
    return checked.withColumn("reasons", failed).where(F.size("reasons") > 0).select(
        "uid", "team_id", *keep, "reasons"
    )


def check_index(index: DataFrame, state: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams whose index entry, feed and state disagree."""
    counts = state.groupBy("team_id").agg(F.count(F.lit(1)).alias("_state"))
    joined = (
        index.select("team_id", F.col("events").alias("_index"))
        .join(teams.select("team_id", F.lit(True).alias("_feed")), "team_id", "full_outer")
        .join(counts, "team_id", "full_outer")
    )
    reason = (
        F.when(F.col("_index").isNull(), "not in index")
        .when(F.col("_feed").isNull(), "no feed")
        .when(F.col("_index") != F.coalesce("_state", F.lit(0)), "event count")
    )
    return joined.select("team_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def incidents(
    runs: DataFrame, by: Sequence[str], time: str = "ts", run_id: str = "run_id"
) -> DataFrame:
    """Open and close times of incidents in a run log with a boolean ``failed``.

    The second failure in a row opens an incident, the next success closes it; ``closed_at`` is
    NULL while it is open. The number of successes so far names the stretch of failures a run
    belongs to. It comes from the distributed running sum, so one very long log is no hot task.
    """
    rows = with_position(
        runs.select(*by, time, run_id, "failed"),
        by,
        [time, run_id],
        {"_stretch": F.when(F.col("failed"), 0).otherwise(1)},
        "_pos",
    )
    # A success closes the stretch before it.
    keyed = rows.withColumn(
        "_stretch", F.when(F.col("failed"), F.col("_stretch")).otherwise(F.col("_stretch") - 1)
    )
    stretches = keyed.groupBy(*by, "_stretch").agg(
        F.count_if("failed").alias("failures"),
        (F.min(F.when(F.col("failed"), F.col("_pos"))) + 1).alias("_pos"),
        F.min(F.when(~F.col("failed"), F.col(time))).alias("closed_at"),
    )
    second = rows.select(*by, "_pos", F.col(time).alias("opened_at"))
    return (
        stretches.where(F.col("failures") >= 2)
        .join(second, [*by, "_pos"])
        .select(*by, "opened_at", "closed_at", "failures")
    )
