"""Player history: segments, player-season containers and their gates.

``segment_rounds`` is the long form: player_id, season_start, season_end, segment_id, name, league,
class_ord, club_no, rank, round, points (NULL for a marker round). ``segments`` has one row per
segment, a container one row per player and season.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import (
    MAX_SAFE_INTEGER,
    affiliation,
    round_header,
    round_value,
    safe_integer,
    suspicious_round_header,
)
from ..functions.classes import CLASSES
from ..functions.fingerprint import fingerprint
from ..functions.seasons import clean
from ..functions.text import folded, last_first_swapped, lowered, squeeze

SEASON = ["player_id", "season_start"]
SEGMENT = [*SEASON, "segment_id"]
UNKNOWN_CLASS = len(CLASSES)

# Header words of history tables and the column each one names.
HEADERS = {
    "rank": ["pl", "platz", "rang"],
    "club_no": ["v-nr", "vnr"],
    "player_id": ["id", "nr"],
    "first_name": ["vorname"],
    "last_name": ["nachname"],
    "name": ["name"],
    "points": ["gesamt"],
}


# --- reading history tables -----------------------------------------------------------------


def map_history_columns(headers: DataFrame, table: str = "table_id") -> DataFrame:
    """Header cells (table, position, header) to one row per table with column positions.

    ``error`` names why a table cannot be used; ``rounds`` lists (number, position) in order.
    """
    plain = F.rtrim(F.lower(squeeze(F.col("header"))), F.lit("."))
    cells = headers.withColumn("_plain", plain).withColumn("_round", round_header(F.col("header")))

    def last(words: Sequence[str]) -> Column:
        return F.max(F.when(F.col("_plain").isin(list(words)), F.col("position")))

    number = F.when(~F.col("_plain").isin(sum(HEADERS.values(), [])), F.col("_round"))
    out = cells.groupBy(table).agg(
        *[last(words).alias(name) for name, words in HEADERS.items()],
        F.array_sort(
            F.collect_list(
                F.when(number.isNotNull(), F.struct(number.alias("number"), F.col("position")))
            )
        ).alias("rounds"),
        F.bool_or(suspicious_round_header(F.col("header"))).alias("_odd"),
        F.count(number).alias("_n"),
        F.count_distinct(number).alias("_distinct"),
        F.max(number).alias("_max"),
    )
    surname = F.col("first_name").isNotNull() & F.col("last_name").isNull()
    out = out.withColumn(
        "last_name", F.when(surname, F.col("name")).otherwise(F.col("last_name"))
    ).withColumn("name", F.when(~surname, F.col("name")))
    named = F.col("name").isNotNull() | (
        F.col("first_name").isNotNull() & F.col("last_name").isNotNull()
    )
    required = (
        F.col("rank").isNotNull() & F.col("player_id").isNotNull() & F.col("points").isNotNull()
    )
    error = (
        F.when(F.col("_n") != F.col("_distinct"), "duplicate round column")
        .when(F.col("_odd"), "invalid round header")
        .when(~required, "missing required column")
        .when(~named, "missing name columns")
        .when(F.col("_max") != F.col("_n"), "incomplete round columns")
    )
    return out.withColumn("error", error).drop("_odd", "_n", "_distinct", "_max")


def parse_history_rows(rows: DataFrame, columns: DataFrame, table: str = "table_id") -> DataFrame:
    """Ranking rows ``(table, row_no, season, league, cells)`` to segments with an error column.

    Rows with ``error`` set are the quarantine; the others are usable segments. ``rounds`` holds
    (round, points, marker).
    """
    joined = rows.join(
        columns.where(F.col("error").isNull()).drop("error").withColumnRenamed("rounds", "_rounds"),
        table,
    )

    def cell(name: str) -> Column:
        return F.coalesce(clean(F.get("cells", F.col(f"{name}"))), F.lit(""))

    picked = joined.select(
        table,
        "row_no",
        clean(F.col("season")).alias("season"),
        squeeze(F.col("league")).alias("league"),
        F.exists("cells", lambda c: clean(c) != "").alias("_filled"),
        cell("player_id").alias("player_id"),
        cell("club_no").alias("_club"),
        F.rtrim(cell("rank"), F.lit(".")).alias("_rank"),
        cell("points").alias("_points"),
        last_first_swapped(
            F.when(F.col("name").isNotNull(), cell("name")).otherwise(
                F.concat_ws(
                    " ",
                    F.nullif(cell("first_name"), F.lit("")),
                    F.nullif(cell("last_name"), F.lit("")),
                )
            )
        ).alias("name"),
        F.transform(
            "_rounds",
            lambda r: F.struct(
                r["number"].cast("bigint").alias("round"),
                round_value(F.get("cells", r["position"])).alias("v"),
            ),
        ).alias("_values"),
    ).where("_filled")
    parsed = picked.select(
        table, "row_no", "season", "league", "player_id", "name",
        safe_integer(F.col("_rank")).alias("rank"),
        safe_integer(F.col("_points")).alias("points"),
        affiliation(F.col("_club")).alias("_aff"),
        F.transform(
            "_values",
            lambda v: F.struct(
                v["round"].alias("round"), v["v"]["points"].alias("points"),
                v["v"]["marker"].alias("marker"),
            ),
        ).alias("rounds"),
        F.exists("_values", lambda v: v["v"]["error"]).alias("_bad_round"),
    )
    numeric = F.filter("rounds", lambda r: r["points"].isNotNull())
    total = F.aggregate(numeric, F.lit(0).cast("bigint"), lambda a, r: a + r["points"])
    parsed = parsed.withColumn("_total", total).withColumn(
        "appearances", F.size(numeric).cast("bigint")
    )
    has_rounds = F.size("rounds") > 0
    no_club = F.col("_aff.club_no").isNull() & F.col("_aff.marker").isNull()
    error = (
        F.when((F.col("player_id") == "") | (F.col("season") == ""), "blank identity")
        .when(~F.col("player_id").rlike("^[0-9]+$"), "invalid player id")
        .when(F.col("league") == "", "blank league")
        .when(~F.col("name").rlike(r"\p{L}"), "invalid name")
        .when(F.col("points").isNull(), "invalid points")
        .when(F.col("rank").isNull(), "invalid rank")
        .when(F.col("_aff.error"), "invalid club number")
        .when(has_rounds & no_club, "blank club number")
        .when(F.col("_bad_round"), "invalid round value")
        .when(has_rounds & (F.col("_total") != F.col("points")), "round total mismatch")
    )
    mean = F.when(F.col("appearances") > 0, F.col("points") / F.col("appearances")).otherwise(0.0)
    return parsed.select(
        table, "row_no", "season", "league", "player_id", "name", "rank", "points",
        F.col("_aff.club_no").alias("club_no"),
        F.col("_aff.marker").alias("affiliation_marker"),
        "rounds",
        F.when(has_rounds, F.col("appearances")).alias("appearances"),
        F.when(has_rounds, mean).alias("points_per_appearance"),
        error.alias("error"),
    )


# --- segments and containers ----------------------------------------------------------------


def segment_id(*parts: str | Column) -> Column:
    """Stable id of one segment."""
    return F.concat(F.lit("sha256:"), fingerprint(*parts))


def build_segments(segment_rounds: DataFrame) -> DataFrame:
    """One row per segment: totals, appearances, last round and the eligibility flag."""
    out = segment_rounds.groupBy(
        *SEGMENT, "season_end", "name", "league", "class_ord", "club_no", "rank"
    ).agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.count("points").alias("appearances"),
        F.coalesce(F.max(F.when(F.col("points").isNotNull(), F.col("round"))), F.lit(-1)).alias(
            "last_round"
        ),
    )
    return mark_preview_eligible(out)


def mark_preview_eligible(segments: DataFrame) -> DataFrame:
    """Complete evidence, at least one appearance and a known class."""
    known = F.coalesce(F.col("class_ord").between(0, UNKNOWN_CLASS - 1), F.lit(False))
    return segments.withColumn(
        "eligible", F.coalesce(F.col("appearances") > 0, F.lit(False)) & known
    )


def segment_order() -> list[Column]:
    """Class, league label, club (missing last), rank, id."""
    return [
        F.coalesce("class_ord", F.lit(UNKNOWN_CLASS)),
        F.lower("league"),
        F.col("club_no").isNull(),
        F.coalesce("club_no", F.lit("")),
        F.col("rank"),
        F.col("segment_id"),
    ]


def primary_key() -> Column:
    """Smallest value marks the primary segment: latest round, most appearances, smallest id."""
    return F.struct(
        -F.col("last_round"), -F.coalesce("appearances", F.lit(0)), F.col("segment_id")
    )


def primary_segment(segments: DataFrame) -> DataFrame:
    """The primary segment of every player-season."""
    picked = segments.groupBy(*SEASON).agg(
        F.min_by(F.struct("segment_id", "league", "name", "club_no"), primary_key()).alias("p")
    )
    return picked.select(
        *SEASON,
        F.col("p.segment_id").alias("primary_segment_id"),
        F.col("p.league").alias("league"),
        F.col("p.name").alias("name"),
        F.col("p.club_no").alias("club_no"),
    )


def order_segments(segments: DataFrame) -> DataFrame:
    """Canonical position of each segment in its player-season."""
    window = Window.partitionBy(*SEASON).orderBy(*segment_order())
    return segments.withColumn("segment_no", F.row_number().over(window))


def overlap_ambiguous(segment_rounds: DataFrame) -> DataFrame:
    """Player-seasons in which one class, club and round has two different results."""
    played = segment_rounds.where(
        F.col("points").isNotNull() & F.col("class_ord").between(0, UNKNOWN_CLASS - 1)
    )
    spread = played.groupBy(*SEASON, "class_ord", "club_no", "round").agg(
        F.min("points").alias("_lo"), F.max("points").alias("_hi")
    )
    return spread.where(F.col("_lo") != F.col("_hi")).select(*SEASON).distinct()


def flag_ambiguity(segments: DataFrame, segment_rounds: DataFrame) -> DataFrame:
    """Identity and round-overlap flags of every player-season."""
    name = folded(squeeze(F.col("name")))
    names = segments.groupBy(*SEASON).agg(
        (F.min(name) != F.max(name)).alias("identity_ambiguous")
    )
    return _with_overlap(names, segment_rounds)


def _with_overlap(seasons: DataFrame, segment_rounds: DataFrame) -> DataFrame:
    overlap = overlap_ambiguous(segment_rounds).withColumn("_overlap", F.lit(True))
    return (
        seasons.join(overlap, SEASON, "left")
        .withColumn("round_overlap_ambiguous", F.coalesce("_overlap", F.lit(False)))
        .drop("_overlap")
    )


def merge_segments(segments: DataFrame, segment_rounds: DataFrame) -> DataFrame:
    """Player-season containers: sums, best rank, the primary segment's label, flags."""
    totals = segments.groupBy(*SEASON).agg(
        F.max("season_end").alias("season_end"),
        F.sum("points").alias("points"),
        F.min("rank").alias("rank"),
        F.count(F.lit(1)).alias("segments"),
        F.min_by(F.struct("segment_id", "league", "name"), primary_key()).alias("p"),
    )
    return totals.join(flag_ambiguity(segments, segment_rounds), SEASON).select(
        *SEASON, "season_end", "points", "rank", "segments",
        F.col("p.segment_id").alias("primary_segment_id"),
        F.col("p.league").alias("league"),
        F.col("p.name").alias("name"),
        "identity_ambiguous", "round_overlap_ambiguous",
    )


def latest_affiliation(segments: DataFrame) -> DataFrame:
    """Club of the segments that reach the season's greatest round, if they agree on one."""
    last = segments.groupBy(*SEASON).agg(F.max("last_round").alias("_max"))
    top = segments.join(last, SEASON).where(
        (F.col("last_round") == F.col("_max")) & (F.col("_max") >= 0)
    )
    clubs = top.groupBy(*SEASON).agg(
        F.min("club_no").alias("_lo"),
        F.max("club_no").alias("_hi"),
        F.bool_or(F.col("club_no").isNull()).alias("_missing"),
    )
    known = ~F.col("_missing") & (F.col("_lo") == F.col("_hi"))
    out = last.select(*SEASON).join(clubs, SEASON, "left")
    return out.select(
        *SEASON,
        F.when(known, F.col("_lo")).alias("club_no"),
        (~F.coalesce(known, F.lit(False))).alias("ambiguous"),
    )


def usable_history(segments: DataFrame, segment_rounds: DataFrame) -> DataFrame:
    """Segments of players whose whole history is usable, with the season's ambiguity flag.

    A player with any invalid segment (see ``check_rows``), or with two seasons that start in the
    same year, is dropped as a whole.
    """
    columns = segments.columns
    # A player has a handful of segments per season, so these windows are as long as a career. The
    # career comes first, behind the names, which Python reads: its rows move by player, once, and all
    # that follows finds them in one place. Rows without an end of the season are bad by their reasons.
    season, career = Window.partitionBy(*SEASON), Window.partitionBy("player_id")
    ended = F.col("season_end").isNotNull()
    distinct = lambda *c: F.size(F.collect_set(F.when(ended, F.struct(*c))).over(career))
    checked = (
        check_rows(segments)
        .withColumn("_name", lowered(squeeze(F.col("name"))))
        .withColumn("_wrong", F.bool_or(F.size("reasons") > 0).over(career))
        .withColumn("_twice", distinct("season_start") != distinct("season_start", "season_end"))
        .where(~F.col("_wrong") & ~F.col("_twice"))
        .withColumn("_conflict", F.min("_name").over(season) != F.max("_name").over(season))
    )
    overlap = overlap_ambiguous(segment_rounds).groupBy("player_id").agg(
        F.collect_set("season_start").alias("_overlaps")
    )
    overlaps = F.coalesce(F.array_contains("_overlaps", F.col("season_start")), F.lit(False))
    return checked.join(overlap, "player_id", "left").select(
        *columns, (F.col("_conflict") | overlaps).alias("ambiguous")
    )


def season_class_totals(history: DataFrame) -> DataFrame:
    """Points, appearances and segments per player, season and class of usable seasons.

    ``history`` needs ``ambiguous`` and ``eligible``.
    """
    usable = history.where(F.col("eligible") & ~F.col("ambiguous"))
    return usable.groupBy(*SEASON, "season_end", "class_ord").agg(
        F.sum("points").alias("points"),
        F.sum("appearances").alias("appearances"),
        F.count(F.lit(1)).alias("segments"),
    )


# --- gates ----------------------------------------------------------------------------------


def _reasons(*checks: tuple[Column, str]) -> Column:
    """Texts of the failed checks; a NULL check counts as failed."""
    return F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks]),
        lambda r: r.isNotNull(),
    )


def check_rows(segments: DataFrame, extra: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Digit-only ids, a valid season, safe integers, a league and a name with a letter."""
    span = F.col("season_end") - F.col("season_start")
    return segments.withColumn(
        "reasons",
        _reasons(
            (F.col("player_id").cast("string").rlike("^[0-9]+$"), "player id"),
            (span.between(1, 2), "season"),
            (F.col("rank").between(0, MAX_SAFE_INTEGER), "rank"),
            (F.col("points").between(0, MAX_SAFE_INTEGER), "points"),
            (squeeze(F.col("league")) != "", "league"),
            (F.col("name").rlike(r"\p{L}"), "name"),
            *extra,
        ),
    )


def affiliation_check() -> tuple[Column, str]:
    """Club number or marker, not both, in a segment that has round evidence."""
    both = F.col("club_no").isNotNull() & F.col("affiliation_marker").isNotNull()
    none = F.col("club_no").isNull() & F.col("affiliation_marker").isNull()
    return ~both & ~(none & (F.col("appearances") > 0)), "affiliation"


def check_evidence(
    segments: DataFrame, rounds: DataFrame, keys: Sequence[str] = SEGMENT
) -> DataFrame:
    """Round evidence against the stored totals.

    Rounds are contiguous from 1, their sum is the points, their count the appearances and the
    mean agrees within 1e-12. ``rounds`` may have several rows per round only by mistake.
    """
    facts = rounds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("round").alias("_distinct"),
        F.max("round").alias("_max"),
        F.min("round").alias("_min"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("_sum"),
        F.count("points").alias("_count"),
    )
    joined = segments.join(facts, list(keys), "left")
    expected = F.when(
        F.col("appearances") > 0, F.col("points") / F.col("appearances")
    ).otherwise(0.0)
    has_rounds = F.col("_rows").isNotNull()
    return joined.withColumn(
        "reasons",
        _reasons(
            (
                ~has_rounds | (
                    (F.col("_min") == 1)
                    & (F.col("_max") == F.col("_distinct"))
                    & (F.col("_rows") == F.col("_distinct"))
                ),
                "round sequence",
            ),
            (~has_rounds | (F.col("_sum") == F.col("points")), "round sum"),
            (~has_rounds | (F.col("_count") == F.col("appearances")), "appearances"),
            (
                ~has_rounds | (F.abs(F.col("points_per_appearance") - expected) <= 1e-12),
                "points per appearance",
            ),
        ),
    ).select(*segments.columns, "reasons")


def check_containers(containers: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored containers against the ones recomputed from segments, column by column."""
    columns = [c for c in expected.columns if c not in SEASON]
    right = expected.select(*SEASON, *[F.col(c).alias(f"_e_{c}") for c in columns])
    both = containers.withColumn("_stored", F.lit(True)).join(
        right.withColumn("_made", F.lit(True)), SEASON, "full_outer"
    )
    checks = [(F.col(c).eqNullSafe(F.col(f"_e_{c}")), c) for c in columns]
    reasons = (
        F.when(F.col("_made").isNull(), F.array(F.lit("no segments")))
        .when(F.col("_stored").isNull(), F.array(F.lit("container missing")))
        .otherwise(_reasons(*checks))
    )
    return both.select(*SEASON, reasons.alias("reasons"))


def check_no_loss(
    previous: DataFrame,
    candidate: DataFrame,
    keys: Sequence[str],
    content: Sequence[str],
    waivers: DataFrame | None = None,
) -> DataFrame:
    """Previous rows that have no, or more than one, equal row in the candidate.

    Rows are compared by a fingerprint of ``content``; ``waivers`` lists the keys that may go.
    Reasons: ``missing`` (key gone), ``changed`` (key kept, content differs), ``ambiguous``.
    """
    print_of = fingerprint(*content)
    left = previous.select(*keys, print_of.alias("_print"))
    right = candidate.select(*keys, print_of.alias("_print"))
    found = right.groupBy(*keys, "_print").agg(F.count(F.lit(1)).alias("_same"))
    known = right.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = left.join(found, [*keys, "_print"], "left").join(known, list(keys), "left")
    if waivers is not None:
        out = out.join(waivers.select(*keys).distinct(), list(keys), "left_anti")
    reason = (
        F.when(F.col("_same") > 1, "ambiguous")
        .when(F.col("_same") == 1, None)
        .when(F.col("_known"), "changed")
        .otherwise("missing")
    )
    return out.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())


def check_drift(
    candidate: DataFrame, previous: DataFrame | None, keys: Sequence[str], json: str,
    allowed: Sequence[str],
) -> DataFrame:
    """JSON fields outside the contract, unless the same row was published with them before."""
    unknown = F.array_except(F.json_object_keys(json), F.array(*[F.lit(a) for a in allowed]))
    found = candidate.withColumn("unknown_fields", F.array_sort(unknown)).where(
        F.size("unknown_fields") > 0
    )
    if previous is not None:
        found = found.join(previous.select(*keys, json), [*keys, json], "left_anti")
    return found.select(*keys, "unknown_fields")


def history_metrics(history: DataFrame, rounds: DataFrame) -> DataFrame:
    """Counts over all segments: players, records, markers, ambiguous, totals-only, eligible."""
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    # One pass: segments into seasons, seasons into players, players into totals.
    seasons = history.groupBy(*SEASON).agg(
        F.count(F.lit(1)).alias("segments"),
        count(F.col("eligible")).alias("eligible_segments"),
        count(F.col("appearances") == 0).alias("totals_only_segments"),
        F.bool_or("ambiguous").alias("_ambiguous"),
    )
    summed = ["segments", "eligible_segments", "totals_only_segments"]
    players = seasons.groupBy("player_id").agg(
        *[F.sum(c).alias(c) for c in summed],
        F.count(F.lit(1)).alias("player_seasons"),
        count(F.col("_ambiguous")).alias("ambiguous_seasons"),
    )
    summed += ["player_seasons", "ambiguous_seasons"]
    totals = players.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed], F.count(F.lit(1)).alias("players")
    )
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in [*summed, "players"]]
    markers = rounds.agg(F.count_if(F.col("points").isNull()).alias("value"))
    return totals.select(F.inline(F.array(*cells))).unionByName(
        markers.select(F.lit("marker_rounds").alias("metric"), "value")
    )
