"""Class calibration and historical priors, for one or many cutoffs at once.

A cutoff is the start year of a target season: only seasons that end by then may be used. All
tables carry ``cutoff`` as a key, so training data for every season comes out of one job.

``totals``: player_id, season_start, season_end, class_ord, points, appearances (usable seasons).
``seasons``: one row per player-season of the usable history, see ``season_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import safe_rating
from ..functions.classes import CLASSES
from .lookups import lookup
from .medians import weighted_medians
from .ordering import top_k

PRIOR_APPEARANCES = 4  # fixed value: weight of the class mean in every rating
MIN_TRANSITIONS = 8  # fixed value: observations an edge needs before it is used
MIN_APPEARANCES = 4  # fixed value: appearances a season needs to be an observation
NEUTRAL_RATING = 1.0  # fixed value: rating without any class mean
SEASON_WEIGHTS = (0.7, 0.3)  # fixed values: newest and second newest season
EDGES = len(CLASSES) - 1


def season_rows(history: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per player-season: observed classes and, for a single class, its totals.

    Both sources are one union, so a player's rows meet in one shuffle by player.
    """
    known = F.when(F.col("class_ord").between(0, EDGES), F.col("class_ord"))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {c: totals.schema[c].dataType for c in ("class_ord", "points", "appearances")}
    both = history.select(
        "player_id", "season_start", "season_end", known.alias("_known"),
        *[none(t).alias(f"_{c}") for c, t in kinds.items()], F.lit(0).alias("_group"),
    ).union(
        totals.select(
            "player_id", "season_start", none(history.schema["season_end"].dataType), none("int"),
            *[F.col(c) for c in kinds], F.lit(1),
        )
    )
    return (
        both.repartition("player_id")
        .groupBy("player_id", "season_start")
        .agg(
            F.max("season_end").alias("season_end"),
            F.coalesce(F.min("_known") != F.max("_known"), F.lit(False)).alias("multi_class"),
            F.sum("_group").cast("bigint").alias("groups"),
            F.min("_class_ord").alias("class_ord"),
            F.sum("_points").alias("points"),
            F.sum("_appearances").alias("appearances"),
            F.min("_group").alias("_seen"),
        )
        .where(F.col("_seen") == 0)
        .drop("_seen")
    )


def class_season_means(totals: DataFrame) -> DataFrame:
    """Mean per class and season, with exact sums."""
    return (
        totals.groupBy("class_ord", "season_start", "season_end")
        .agg(
            F.sum(F.col("points").cast("decimal(38,0)")).alias("points"),
            F.sum(F.col("appearances").cast("decimal(38,0)")).alias("appearances"),
            F.count(F.lit(1)).alias("player_records"),
        )
        .withColumn(
            "mean", F.col("points").cast("double") / F.col("appearances").cast("double")
        )
    )


def stabilize(seasons: DataFrame, means: DataFrame) -> DataFrame:
    """Season rating of single-class seasons, pulled to the class mean by four appearances."""
    keys = ["class_ord", "season_start"]
    found = lookup(means, keys, F.struct("mean"))
    single = seasons.where(F.col("groups") == 1).withColumn("_m", found(*keys))
    return single.where(F.col("_m").isNotNull()).select(
        *seasons.columns,
        F.col("_m.mean").alias("mean"),
        (
            (F.col("points") + PRIOR_APPEARANCES * F.col("_m.mean"))
            / (F.col("appearances") + PRIOR_APPEARANCES)
        ).alias("stable"),
    )


def consecutive_seasons(seasons: DataFrame) -> DataFrame:
    """Each player-season with the player's next older one (columns ``older_*``).

    A player has one row per season, so the window is as long as a career.
    """
    window = Window.partitionBy("player_id").orderBy(F.col("season_end"), F.col("season_start"))
    names = [c for c in seasons.columns if c != "player_id"]
    out = seasons
    for c in names:
        out = out.withColumn(f"older_{c}", F.lag(c).over(window))
    return out.where(F.col("older_season_start").isNotNull())


def transitions(seasons: DataFrame) -> DataFrame:
    """Pairs of neighbouring seasons with the observation or the first rule that excludes them."""
    pairs = consecutive_seasons(seasons)
    gap = F.abs(F.col("class_ord") - F.col("older_class_ord"))
    reason = (
        F.when(F.col("older_season_end") != F.col("season_start"), "nonconsecutive")
        .when(F.col("multi_class") | F.col("older_multi_class"), "multiClass")
        .when((F.col("groups") != 1) | (F.col("older_groups") != 1), "incompleteEvidence")
        .when(gap == 0, "sameClass")
        .when(gap != 1, "nonAdjacentOrUnknownClass")
        .when(
            (F.col("appearances") < MIN_APPEARANCES)
            | (F.col("older_appearances") < MIN_APPEARANCES),
            "insufficientAppearances",
        )
    )
    newer = F.col("points") / F.col("appearances")
    older = F.col("older_points") / F.col("older_appearances")
    newer_high = F.col("class_ord") < F.col("older_class_ord")
    used = reason.isNull()
    return pairs.select(
        "player_id",
        F.col("older_season_start").alias("older_start"),
        "season_start",
        "season_end",
        reason.alias("reason"),
        F.when(used, F.least("class_ord", "older_class_ord")).alias("edge"),
        F.when(used, F.when(newer_high, older - newer).otherwise(newer - older)).alias("value"),
        F.when(used, F.least("appearances", "older_appearances")).alias("raw_weight"),
    )


def exclusion_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per exclusion reason."""
    return (
        rows.where(F.col("reason").isNotNull())
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("excluded"))
    )


def before_season(df: DataFrame, cutoff: Column, end: str = "season_end") -> DataFrame:
    """Seasons that ended before a target season that starts in ``cutoff``."""
    return df.where(F.col(end) <= cutoff)


def for_cutoffs(df: DataFrame, cutoffs: DataFrame, end: str = "season_end") -> DataFrame:
    """Rows usable before each cutoff, one copy per later target season.

    The distinct cutoffs are one row with an array of years, read as a scalar subquery.
    """
    years = cutoffs.agg(F.sort_array(F.collect_set("cutoff"))).scalar()
    return df.withColumn("cutoff", F.explode(years)).where(F.col("cutoff") >= F.col(end))


def weight_caps(df: DataFrame, by: Sequence[str], weight: str = "raw_weight") -> DataFrame:
    """Lower median of the weights of each group, and twice that.

    Works on counts per distinct weight, so no group of rows meets in one task.
    """
    counts = df.groupBy(*by, weight).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(weight).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(group))
        .where(F.col("_upto") >= F.floor((F.col("_all") - 1) / 2) + 1)
        .groupBy(*by)
        .agg(F.min(weight).alias("weight_median"))
        .withColumn("weight_cap", F.col("weight_median") * 2)
    )


def cap_weights(df: DataFrame, by: Sequence[str], weight: str = "raw_weight") -> DataFrame:
    """Cap weights at twice the lower median of their group. Rows stay where they are."""
    caps = lookup(weight_caps(df, by, weight), by, F.struct("weight_median", "weight_cap"))
    return df.withColumn("_cap", caps(*by)).select(
        *df.columns, "_cap.*", F.least(weight, "_cap.weight_cap").alias("weight")
    )


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median: the first value whose running weight reaches half of the total."""
    return weighted_medians(df, by, value, weight).select(*by, "median", "total_weight")


def calibrate_classes(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Offset of each class edge (per cutoff if ``by`` has it), with its diagnostics.

    ``published`` edges have at least eight observations; only those may convert ratings. Weights are
    capped at twice their lower median; no row moves by cutoff or edge.
    """
    used = observations.where(F.col("reason").isNull())
    facts = weighted_medians(used, [*by, "edge"], "value", "raw_weight", cap=True)
    return facts.withColumnRenamed("median", "offset").withColumn(
        "published", F.col("observations") >= MIN_TRANSITIONS
    )


def edge_row(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per cutoff) with the published offsets ``edge_0`` .. ``edge_2``."""
    published = edges.where("published")
    return published.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("edge") == i, F.col("offset"))).alias(f"edge_{i}")
            for i in range(EDGES)
        ]
    )


def convert_rating(rating: Column, source: Column, target: Column) -> Column:
    """``(rating, calibrated)`` along the chain of ``edge_*`` columns.

    If any edge on the way is missing, the rating stays as it is and is not calibrated.
    """
    shift, missing = F.lit(0.0), F.lit(False)
    for i in range(EDGES):
        edge = F.col(f"edge_{i}")
        down = (source <= i) & (target > i)
        up = (target <= i) & (source > i)
        shift = shift + F.when(down, F.coalesce(edge, F.lit(0.0))).when(
            up, -F.coalesce(edge, F.lit(0.0))
        ).otherwise(0.0)
        missing = missing | ((down | up) & edge.isNull())
    return F.struct(
        F.when(missing, rating).otherwise(rating + shift).alias("rating"),
        (~missing).alias("calibrated"),
    )


def with_mean_before(targets: DataFrame, means: DataFrame, name: str) -> DataFrame:
    """``targets`` with the mean of the newest season of ``target_ord`` that ended by ``cutoff``.

    The seasons of a class are one lookup value; class-season means are one row per class and season.
    """
    usable = means.where(safe_rating(F.col("mean")).isNotNull())
    by_class = usable.groupBy("class_ord").agg(F.collect_list(F.struct("season_end", "mean")).alias("_all"))
    seasons = lookup(by_class, ["class_ord"], F.col("_all"))
    ended = F.filter("_all", lambda s: s["season_end"] <= F.col("cutoff"))
    return targets.withColumn("_all", seasons("target_ord")).withColumn(
        name, F.array_max(ended)["mean"]
    ).drop("_all")


def target_mean(targets: DataFrame, means: DataFrame) -> DataFrame:
    """Mean of the newest class season that ended before each ``(cutoff, target_ord)``.

    Falls back to the neutral rating; ``mean_available`` tells which.
    """
    keys = with_mean_before(targets.select("cutoff", "target_ord").distinct(), means, "_mean")
    return keys.select(
        "cutoff",
        "target_ord",
        F.coalesce("_mean", F.lit(NEUTRAL_RATING)).alias("target_mean"),
        F.col("_mean").isNotNull().alias("mean_available"),
    )


def last_two_before(seasons: DataFrame, targets: DataFrame) -> DataFrame:
    """The newest two seasons of each player before each cutoff, usable or not.

    ``back`` is 1 for the newest. The window is cut before usability is tested.
    """
    keys = targets.select("player_id", "cutoff").distinct()
    joined = keys.join(
        seasons.select("player_id", "season_start", "season_end"), "player_id"
    ).where(F.col("season_end") <= F.col("cutoff"))
    order = [F.col("season_end").desc(), F.col("season_start").desc()]
    return top_k(joined, ["player_id", "cutoff"], order, 2, "back")


def _careers(targets: DataFrame, seasons: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per player: _wanted targets, _past seasons and class _groups as arrays.

    Three tagged sources, one shuffle by player. A player has few seasons and few targets.
    """
    item = {
        "_wanted": F.struct("cutoff", "target_ord"),
        "_past": F.struct("season_end", "season_start"),
        "_groups": F.struct("season_start", "class_ord", "points", "appearances"),
    }
    sources = dict(zip(item, (targets, seasons, totals)))
    kinds = {n: sources[n].select(item[n].alias("x")).schema["x"].dataType for n in item}
    rows = [
        sources[n].select(
            "player_id", *[(item[m] if m == n else F.lit(None).cast(kinds[m])).alias(m) for m in item]
        )
        for n in item
    ]
    collected = rows[0].union(rows[1]).union(rows[2]).groupBy("player_id").agg(
        F.collect_set("_wanted").alias("_wanted"), F.collect_set("_past").alias("_past"),
        F.collect_list("_groups").alias("_groups"),
    )
    return collected.where(F.size("_wanted") > 0)


def historical_prior(
    targets: DataFrame,
    seasons: DataFrame,
    totals: DataFrame,
    means: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """Prior rating of each ``(player_id, cutoff, target_ord)``.

    Every class group of the last two seasons is converted to the target class and weighted by
    appearances; the class mean counts as four more appearances; the seasons weigh 0.7 and 0.3.
    ``edges`` is ``edge_row(.., ["cutoff"])``. Class means and edges are looked up in place; a
    player's rows meet once, in arrays.
    """
    keys = ["player_id", "cutoff", "target_ord"]
    names = [f"edge_{i}" for i in range(EDGES)]
    offsets = lookup(edges, ["cutoff"], F.struct(*names))
    wanted = (
        _careers(targets, seasons, totals)
        .withColumn("_t", F.explode("_wanted"))
        .select("player_id", "_t.*", "_past", "_groups")
    )
    wanted = with_mean_before(wanted, means, "_mean").withColumn("_edges", offsets("cutoff"))
    ended = F.filter("_past", lambda s: s["season_end"] <= F.col("cutoff"))
    own = F.filter("_groups", lambda g: g["season_start"] == F.col("_s.season_start"))
    # From here on all rows of a player are in one partition: the groupings need no shuffle.
    groups = (
        wanted.select(*keys, "_mean", "_edges", "_groups", F.posexplode_outer(
            F.slice(F.sort_array(ended, asc=False), 1, 2)).alias("_back", "_s"))
        .select(*keys, "_mean", "_edges", "_back", "_s", F.explode_outer(own).alias("_g"))
        .select(*keys, F.coalesce("_mean", F.lit(NEUTRAL_RATING)).alias("target_mean"),
                F.col("_mean").isNotNull().alias("mean_available"), "_back", "_s.*",
                F.col("_g.class_ord"), F.col("_g.points"), F.col("_g.appearances"), "_edges.*")
        .withColumn("_c", convert_rating(
            F.col("points") / F.col("appearances"), F.col("class_ord"), F.col("target_ord")))
    )
    # A group whose conversion falls below zero makes the whole season unusable.
    per_season = groups.groupBy(
        *keys, "target_mean", "mean_available", "_back", "season_start", "season_end"
    ).agg(
        F.sum(F.col("_c.rating") * F.col("appearances")).alias("_weighted"),
        F.sum("appearances").alias("_app"),
        F.bool_and("_c.calibrated").alias("_cal"),
        F.bool_and(F.col("_c.rating") >= 0).alias("_ok"),
        F.collect_set("class_ord").alias("_classes"),
    )
    rating = (F.col("_weighted") + PRIOR_APPEARANCES * F.col("target_mean")) / (F.col("_app") + PRIOR_APPEARANCES)
    rated = per_season.withColumn("_rating", safe_rating(F.when(F.col("_ok"), rating)))
    used = lambda c: F.when(F.col("_rating").isNotNull(), F.col(c))
    at = lambda back: F.max(F.when(F.col("_back") == back, F.col("_rating")))
    out = rated.groupBy(*keys, "target_mean", "mean_available").agg(
        F.count("_rating").alias("_n"),
        at(0).alias("_r1"),
        at(1).alias("_r2"),
        F.coalesce(F.bool_and(used("_cal")), F.lit(False)).alias("class_calibrated"),
        F.min(used("_app")).alias("_min_app"),
        F.max(used("season_start")).alias("newest_source"),
        F.max(used("season_end")).alias("newest_source_end"),
        F.flatten(F.collect_list(used("_classes"))).alias("_classes"),
    )
    newest, older = SEASON_WEIGHTS
    prior = F.when(
        F.col("_n") == 2, newest * F.col("_r1") + older * F.col("_r2")
    ).otherwise(F.coalesce("_r1", "_r2"))
    solid = (F.col("_n") == 2) & (F.col("_min_app") >= PRIOR_APPEARANCES)
    confidence = F.when(
        F.col("class_calibrated"), F.when(solid, "medium").otherwise("provisional")
    ).otherwise("very-low")
    return out.select(
        *keys,
        F.coalesce(prior, "target_mean").alias("prior"),
        F.col("_n").alias("prior_seasons"),
        "class_calibrated",
        confidence.alias("confidence"),
        "newest_source",
        "newest_source_end",
        F.array_sort(F.array_distinct("_classes")).alias("source_classes"),
        "target_mean",
        "mean_available",
    )


def calibration_tables(
    history: DataFrame, totals: DataFrame, cutoffs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(seasons, means, edges per cutoff)`` for every cutoff in one pass."""
    seasons = season_rows(history, totals)
    observations = for_cutoffs(transitions(seasons), cutoffs)
    edges = calibrate_classes(observations, ["cutoff"])
    return seasons, class_season_means(totals), edge_row(edges, ["cutoff"])


def backtest(history: DataFrame, totals: DataFrame) -> DataFrame:
    """Chronological samples: every single-class season predicted from earlier seasons only.

    Baselines: the previous season's raw mean, and 0.7 / 0.3 of the last two raw means without
    conversion. Only players with two usable earlier single-class seasons in the window give a
    sample.
    """
    single = totals.groupBy("player_id", "season_start", "season_end").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("class_ord").alias("class_ord"),
        (F.sum("points") / F.sum("appearances")).alias("actual"),
    ).where(F.col("_n") == 1).drop("_n")
    targets = single.select(
        "player_id",
        F.col("season_start").alias("cutoff"),
        F.col("class_ord").alias("target_ord"),
        "actual",
    )
    seasons, means, edges = calibration_tables(history, totals, targets)
    prior = historical_prior(targets, seasons, totals, means, edges)
    raw = last_two_before(seasons, targets).join(
        single.select("player_id", "season_start", F.col("actual").alias("_raw")),
        ["player_id", "season_start"],
    )
    raw = raw.groupBy("player_id", "cutoff").agg(
        F.max(F.when(F.col("back") == 1, F.col("_raw"))).alias("previous"),
        F.max(F.when(F.col("back") == 2, F.col("_raw"))).alias("_before"),
    )
    newest, older = SEASON_WEIGHTS
    return (
        targets.join(prior, ["player_id", "cutoff", "target_ord"])
        .join(raw, ["player_id", "cutoff"])
        .where(F.col("previous").isNotNull() & F.col("_before").isNotNull())
        .select(
            "player_id",
            F.col("cutoff").alias("season_start"),
            F.col("target_ord").alias("class_ord"),
            "actual",
            F.col("prior").alias("hybrid"),
            "previous",
            (newest * F.col("previous") + older * F.col("_before")).alias("unadjusted"),
            (F.col("newest_source_end") > F.col("cutoff")).alias("leak"),
        )
    )


def backtest_metrics(samples: DataFrame) -> DataFrame:
    """Mean absolute errors and coverage by season, by class and overall."""
    fields = ["hybrid", "previous", "unadjusted"]
    errors = samples.select(
        "season_start", "class_ord",
        *[F.abs(F.col(f) - F.col("actual")).alias(f"mae_{f}") for f in fields],
        F.col("leak").cast("int").alias("_leak"),
    )
    return errors.groupingSets(
        [[F.col("season_start")], [F.col("class_ord")], []],
        F.col("season_start"),
        F.col("class_ord"),
    ).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.avg(f"mae_{f}").alias(f"mae_{f}") for f in fields],
        F.sum("_leak").alias("leaks"),
    )
