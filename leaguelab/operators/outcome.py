"""Three-way outcome model: training examples, grid calibration and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import confidence_name, confidence_ordinal, half_up, nonnegative, safe_rating
from .roster import LINEUP

# Parameter grid, in the order in which ties are decided.
GRID = {
    "scale": [0.5, 1.0, 2.0, 4.0],
    "home_advantage": [0.0, 0.25, 0.5],
    "draw_peak": [0.25, 0.5, 1.0],
    "draw_decay": [0.25, 0.5, 1.0],
}
# Least training data, clamp of the exponent, width of the forecast range.
MIN_EXAMPLES, MIN_PER_OUTCOME = 40, 5
MAX_EXPONENT = 50.0
BASE_WIDTH, MAX_WIDTH = 0.03, 0.45
TIE_DIGITS = 15
OUTCOMES = ["home", "draw", "away"]


def outcome_probs(home: Column, away: Column, params: Column) -> Column:
    """``(home, draw, away)`` probabilities of two ratings under one parameter struct."""
    d = (home - away) / params["scale"] + params["home_advantage"]
    clamp = lambda x: F.greatest(F.lit(-MAX_EXPONENT), F.least(F.lit(MAX_EXPONENT), x))
    raw_home, raw_away = F.exp(clamp(d)), F.exp(clamp(-d))
    raw_draw = params["draw_peak"] * F.exp(-params["draw_decay"] * F.abs(d))
    total = raw_home + raw_draw + raw_away
    return F.struct(
        (raw_home / total).alias("home"),
        (raw_draw / total).alias("draw"),
        (raw_away / total).alias("away"),
    )


def grid() -> Column:
    """The parameter grid as an array literal of structs with their number."""
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("grid_no"),
                *[F.lit(v).alias(name) for name, v in zip(GRID, values)],
            )
            for n, values in enumerate(product(*GRID.values()))
        ]
    )


def with_grid(examples: DataFrame) -> DataFrame:
    """Every example once per grid point. The grid is a literal, so nothing is shuffled."""
    return examples.withColumn("params", F.explode(grid()))


def brier(examples: DataFrame) -> DataFrame:
    """Mean of the three squared errors per grid point.

    The error depends on the rating difference and the outcome only, so equal pairs are counted
    before the grid multiplies the rows.
    """
    pairs = examples.groupBy(
        (F.col("home_rating") - F.col("away_rating")).alias("_d"), "outcome"
    ).agg(F.count(F.lit(1)).alias("_n"))
    rows = with_grid(pairs).withColumn(
        "_p", outcome_probs(F.col("_d"), F.lit(0.0), F.col("params"))
    )
    error = F.lit(0.0)
    for name in OUTCOMES:
        hit = F.when(F.col("outcome") == name, 1.0).otherwise(0.0)
        error = error + (F.col(f"_p.{name}") - hit) * (F.col(f"_p.{name}") - hit)
    sums = rows.groupBy(F.col("params.grid_no").alias("_no")).agg(
        F.sum(error * F.col("_n")).alias("_error"), F.sum("_n").alias("examples")
    )
    return sums.select(
        F.element_at(grid(), F.col("_no") + 1).alias("params"),
        (F.col("_error") / F.col("examples")).alias("brier"),
        "examples",
    )


def usable_examples(examples: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Examples with two finite ratings and a known outcome, one per key, before the cutoff.

    Of equal keys the one with the smallest values stays.
    """
    rows = examples.where(
        (F.coalesce("key", F.lit("")) != "")
        & nonnegative(F.col("home_rating")).isNotNull()
        & nonnegative(F.col("away_rating")).isNotNull()
        & F.col("outcome").isin(OUTCOMES)
    )
    if cutoff is not None:
        rows = rows.where(F.col("season_end") <= cutoff)
    first = F.struct("home_rating", "away_rating", "outcome")
    return rows.groupBy("key").agg(F.min(first).alias("_e")).select("key", "_e.*")


def calibrate_outcome(examples: DataFrame) -> DataFrame:
    """One row: the grid point with the least Brier score, or ``calibrated`` false.

    Needs 40 examples and 5 of each outcome; ties go to the first grid point.
    """
    counts = examples.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES],
    )
    enough = (F.col("n") >= MIN_EXAMPLES) & (F.least(*OUTCOMES) >= MIN_PER_OUTCOME)
    best = brier(examples).agg(
        F.min_by(
            F.struct("params", "brier"),
            F.struct(F.round("brier", TIE_DIGITS), F.col("params.grid_no")),
        )
    )
    one = counts.withColumn("calibrated", enough).withColumn("_best", best.scalar())
    pick = lambda c: F.when(F.col("calibrated"), F.col(f"_best.{c}")).alias(c.split(".")[-1])
    return one.select(
        "calibrated", F.col("n").alias("examples"), *[pick(f"params.{name}") for name in GRID],
        pick("brier"),
    )


# --- training examples ---------------------------------------------------------------------------


def match_participants(rounds: DataFrame, mapping: DataFrame) -> DataFrame:
    """Players with a result per (season, class, round, club, team).

    ``rounds``: usable history rounds with points; ``team_label`` says which team of a club a
    segment belongs to (NULL = only right for a club with one team).
    """
    bucket = ["season_start", "class_ord", "round", "club_no"]
    played = rounds.where(F.col("points").isNotNull() & F.col("club_no").isNotNull())
    clubs = mapping.select("club_no", "team_id", "label", "multi_team").distinct()
    joined = played.join(clubs, "club_no").where(
        F.when(F.col("team_label").isNull(), ~F.col("multi_team")).otherwise(
            F.col("team_label") == F.col("label")
        )
    )
    return joined.select(*bucket, "team_id", "player_id").distinct()


def full_lineups(participants: DataFrame) -> DataFrame:
    """Buckets of exactly four players with their ids.

    Counted first; only four-player buckets are collected.
    """
    bucket = ["season_start", "class_ord", "round", "club_no", "team_id"]
    full = (
        participants.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == LINEUP)
        .drop("_n")
    )
    return (
        participants.join(full, bucket, "left_semi")
        .groupBy(*bucket)
        .agg(F.sort_array(F.collect_list("player_id")).alias("players"))
    )


def distinct_matches(matches: DataFrame) -> DataFrame:
    """One row per match identity; identities with two different scores are marked.

    ``matches`` come from ``map_match_teams``.
    """
    identity = [
        "season_start", "round", "class_ord", "home_club", "home_team", "away_club", "away_team",
    ]
    score = F.struct("home_score", "away_score")
    out = matches.where(F.col("reason").isNull()).groupBy(*identity).agg(
        F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.count(F.lit(1)).alias("copies")
    )
    return out.select(
        *identity,
        F.col("_lo.home_score").alias("home_score"),
        F.col("_lo.away_score").alias("away_score"),
        "copies",
        F.when(F.col("_lo") != F.col("_hi"), "conflictingDuplicate").alias("reason"),
    )


def reject_shared_players(matches: DataFrame) -> DataFrame:
    """Mark matches in which a player stands on both sides."""
    shared = F.arrays_overlap("home_players", "away_players")
    return matches.withColumn("reason", F.coalesce("reason", F.when(shared, "crossSidePlayer")))


def lined_up_matches(matches: DataFrame, lineups: DataFrame) -> DataFrame:
    """Matches with the line-ups of both sides, and the first rule that excludes them."""

    def side(prefix: str) -> DataFrame:
        return lineups.select(
            "season_start", "class_ord", "round",
            F.col("club_no").alias(f"{prefix}_club"),
            F.col("team_id").alias(f"{prefix}_team"),
            F.col("players").alias(f"{prefix}_players"),
        )

    out = matches
    for prefix in ("home", "away"):
        keys = ["season_start", "class_ord", "round", f"{prefix}_club", f"{prefix}_team"]
        out = out.join(side(prefix), keys, "left")
    missing = F.col("home_players").isNull() | F.col("away_players").isNull()
    out = out.withColumn("reason", F.coalesce("reason", F.when(missing, "participants")))
    return reject_shared_players(out)


def example_targets(matches: DataFrame) -> DataFrame:
    """``(player_id, cutoff, target_ord)`` of all players of usable matches."""
    return (
        matches.where(F.col("reason").isNull())
        .select(
            F.explode(F.concat("home_players", "away_players")).alias("player_id"),
            F.col("season_start").alias("cutoff"),
            F.col("class_ord").alias("target_ord"),
        )
        .distinct()
    )


def outcome_examples(matches: DataFrame, priors: DataFrame) -> DataFrame:
    """Training examples: side ratings from strictly earlier seasons, and the outcome.

    ``matches`` come from ``lined_up_matches``; ``priors`` cover ``example_targets``.
    """
    usable = matches.where(F.col("reason").isNull()).withColumn(
        "key",
        F.concat_ws(
            "|", "season_start", "round", "class_ord",
            F.concat_ws(":", "home_club", "home_team"), F.concat_ws(":", "away_club", "away_team"),
        ),
    )
    keep = ["key", "season_start", "round", "class_ord", "home_score", "away_score"]
    sides = F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_players").alias("players")),
        F.struct(F.lit("away").alias("side"), F.col("away_players").alias("players")),
    )
    players = usable.select(*keep, F.explode(sides).alias("_s")).select(
        *keep, F.col("_s.side").alias("side"), F.explode("_s.players").alias("player_id")
    )
    rated = players.withColumn("cutoff", F.col("season_start")).withColumn(
        "target_ord", F.col("class_ord")
    ).join(
        priors.select("player_id", "cutoff", "target_ord", "prior"),
        ["player_id", "cutoff", "target_ord"],
    )
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("prior")))
    out = rated.groupBy(*keep).agg(
        mean("home").alias("home_rating"), mean("away").alias("away_rating")
    )
    outcome = (
        F.when(F.col("home_score") > F.col("away_score"), "home")
        .when(F.col("home_score") < F.col("away_score"), "away")
        .otherwise("draw")
    )
    return out.withColumn("outcome", outcome).drop("home_score", "away_score")


# --- forecasts -------------------------------------------------------------------------------------


def forecast(matches: DataFrame, summaries: DataFrame, model: DataFrame) -> DataFrame:
    """Forecast of every match from its two line-up summaries.

    ``matches``: match_id, home_lineup, away_lineup (ids of ``summaries.lineup_id``). ``model`` is
    the one row of ``calibrate_outcome``. Without a calibrated model or a valid line-up only the
    relative strength is given.
    """

    def side(prefix: str) -> DataFrame:
        return summaries.select(
            F.col("lineup_id").alias(f"{prefix}_lineup"),
            *[
                F.col(c).alias(f"{prefix}_{c}")
                for c in ("valid", "score", "confidence", "uncertainty")
            ],
        )

    row = model.select(F.struct("calibrated", *GRID)).scalar()
    joined = matches.join(side("home"), "home_lineup").join(side("away"), "away_lineup")
    joined = joined.withColumn("_m", row).withColumn(
        "_p", outcome_probs(F.col("home_score"), F.col("away_score"), F.col("_m"))
    )
    usable = (
        F.col("home_valid") & F.col("away_valid") & F.coalesce(F.col("_m.calibrated"), F.lit(False))
    )
    width = F.least(
        F.lit(MAX_WIDTH),
        F.lit(BASE_WIDTH) + (F.col("home_uncertainty") + F.col("away_uncertainty")) / 2,
    )
    total = F.col("home_score") + F.col("away_score")
    share = F.when(total > 0, F.try_divide(F.col("home_score"), total)).otherwise(0.5)
    worst = F.greatest(
        confidence_ordinal(F.col("home_confidence")), confidence_ordinal(F.col("away_confidence"))
    )
    columns: list[Column] = []
    for name in OUTCOMES:
        p = F.col(f"_p.{name}")
        columns += [
            F.when(usable, p).alias(name),
            F.when(usable, F.greatest(F.lit(0.0), p - width)).alias(f"{name}_low"),
            F.when(usable, F.least(F.lit(1.0), p + width)).alias(f"{name}_high"),
        ]
    return joined.select(
        *matches.columns,
        F.when(usable, "probability").otherwise("relative").alias("mode"),
        *columns,
        "home_score",
        "away_score",
        share.alias("home_share"),
        (1 - share).alias("away_share"),
        confidence_name(worst).alias("confidence"),
    )


def pair_matrix(lineups: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The 4 x 4 pair strengths of two line-ups held as slot arrays ``home_slots``, ``away_slots``.

    Share home / (home + away), integer percent, an uncertainty flag and a band.
    """
    first = lineups.select(*keep, F.explode("home_slots").alias("h"), "away_slots")
    rows = first.select(*keep, "h", F.explode("away_slots").alias("a"))
    home, away = safe_rating(F.col("h.rating")), safe_rating(F.col("a.rating"))
    share = F.when(home.isNotNull() & away.isNotNull(), F.try_divide(home, home + away))
    rows = rows.withColumn("_share", share)

    def weak(slot: str) -> Column:
        return (
            (confidence_ordinal(F.col(f"{slot}.confidence")) == 3)
            | ~F.coalesce(
                F.col(f"{slot}.evidence").isin("current+history", "current", "historical"),
                F.lit(False),
            )
            | F.coalesce(F.col(f"{slot}.unconfirmed"), F.lit(False))
        )

    percent = half_up(F.coalesce("_share", F.lit(0.5)) * 100)
    return rows.select(
        *keep,
        F.col("h.slot").alias("home_slot"),
        F.col("a.slot").alias("away_slot"),
        F.coalesce("_share", F.lit(0.5)).alias("home_share"),
        percent.alias("home_percent"),
        (100 - percent).alias("away_percent"),
        (F.col("_share").isNull() | weak("h") | weak("a")).alias("uncertain"),
        F.when(percent >= 55, "home").when(percent <= 45, "away").otherwise("even").alias("band"),
    )
