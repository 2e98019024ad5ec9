"""Differences between a previous and a current snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..lineage import cut_lineage
from .lookups import dealt_join
from .ordering import with_position


def diff_by_key(
    previous: DataFrame, candidate: DataFrame, keys: Sequence[str], content: Sequence[str]
) -> DataFrame:
    """Full outer comparison: added, removed, changed or same for every key."""
    left = previous.select(*keys, fingerprint(*content).alias("previous_print"))
    right = candidate.select(*keys, fingerprint(*content).alias("candidate_print"))
    change = (
        F.when(F.col("previous_print").isNull(), "added")
        .when(F.col("candidate_print").isNull(), "removed")
        .when(F.col("previous_print") == F.col("candidate_print"), "same")
        .otherwise("changed")
    )
    return left.join(right, list(keys), "full_outer").withColumn("change", change)


def lost_seasons(previous: DataFrame, candidate: DataFrame, season: str = "season") -> DataFrame:
    """Seasons of the previous snapshot that the candidate no longer has."""
    return previous.select(season).distinct().join(
        candidate.select(season).distinct(), season, "left_anti"
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two data sets hold the same rows with the same multiplicity.

    One row: ``rows_a, rows_b, unequal`` (distinct rows whose counts differ).
    """
    columns = list(a.columns)
    counted = (
        a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(*columns)
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    return counted.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("rows_b"),
        F.count_if(F.col("_a") != F.col("_b")).alias("unequal"),
    )


def refresh_changes(previous: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Old and new value of every key and their difference; a missing key counts as 0."""
    left = previous.select(key, F.col(value).alias("_p"))
    right = current.select(key, F.col(value).alias("_c"))
    old = F.coalesce("_p", F.lit(0)).cast("bigint")
    new = F.coalesce("_c", F.lit(0)).cast("bigint")
    return left.join(right, key, "full_outer").select(
        key, old.alias("previous"), new.alias("current"), (new - old).alias("delta")
    )


def plain_changes(
    previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """One row per differing field of two unversioned snapshots, values as text."""
    left = previous.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields])
    right = current.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields])
    joined = left.join(right, key, "full_outer")
    changes = F.array(
        *[
            F.when(
                ~F.col(f"_p_{f}").eqNullSafe(F.col(f"_c_{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"_p_{f}").cast("string").alias("previous"),
                    F.col(f"_c_{f}").cast("string").alias("current"),
                ),
            )
            for f in fields
        ]
    )
    return (
        joined.select(key, F.explode(changes).alias("c")).where(F.col("c").isNotNull())
        .select(key, "c.*")
    )


def results_fingerprint(games: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order-independent fingerprint and number of the completed games of each team.

    Each game is hashed on its own; the group keeps the count and four sums over the whole hash, so a
    team with very many games is combined before the shuffle and never collected.
    """
    done = games.where("played")
    item = fingerprint("league", "starts_at", "home", "away", "round", "home_score", "away_score")
    part = lambda n: F.conv(F.substring(item, 16 * n + 1, 16), 16, 10).cast("decimal(38,0)")
    names = [f"_s{n}" for n in range(4)]
    sums = done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("result_count"), *[F.sum(part(n)).alias(s) for n, s in enumerate(names)]
    )
    return sums.select(
        *by, "result_count", fingerprint("result_count", *names).alias("result_fingerprint")
    )


VISIT_FIELDS = {
    "player": ["player", "source_key", "source_season", "source_state", "class"],
    "team": ["team", "team_source_key", "team_source_season", "team_source_state"],
}


def visit_changes(previous: DataFrame, current: DataFrame, key: str = "visitor") -> DataFrame:
    """Changes between two versioned snapshots of each visitor.

    Columns: player, rank, points, source_key, source_season, source_state, class; team,
    result_count, result_fingerprint, team_source_key, team_source_season, team_source_state;
    game_key, game_date, game_location, game_opponent; data_key, updated_at.
    Rank and points count only while the ranking source is the same; results by count, then by
    fingerprint; the generic ``data`` change comes only if there is nothing else and the data are
    newer.
    """
    names = [c for c in current.columns if c != key]
    joined = previous.select(key, *[F.col(c).alias(f"p_{c}") for c in names]).join(
        current.select(key, *[F.col(c).alias(f"c_{c}") for c in names]), key
    )
    p = lambda c: F.col(f"p_{c}")
    c = lambda c: F.col(f"c_{c}")

    def same(fields: Sequence[str]) -> Column:
        first, second, *rest = fields
        ok = (p(first) == c(first)) & (p(second) == c(second))
        for f in rest:
            ok = ok & p(f).eqNullSafe(c(f))
        return F.coalesce(ok, F.lit(False))

    differs = lambda f: ~p(f).eqNullSafe(c(f))
    player, team = same(VISIT_FIELDS["player"]), same(VISIT_FIELDS["team"])
    had, has = p("game_opponent").isNotNull(), c("game_opponent").isNotNull()
    same_game = F.coalesce(p("game_key") == c("game_key"), F.lit(False))
    details = differs("game_date") | differs("game_location") | differs("game_opponent")
    game = (
        F.when(~team, None)
        .when(~had & has, "set")
        .when(had & ~has, "cancelled")
        .when(had & has & same_game & details, "rescheduled")
        .when(had & has & ~same_game & (details | differs("game_key")), "replaced")
    )
    results = F.when(~team, None).when(
        differs("result_count"),
        F.when(c("result_count") > p("result_count"), "new").otherwise("corrected"),
    ).when(differs("result_fingerprint"), "updated")

    def change(kind: str, detail: Column) -> Column:
        return F.when(
            detail.isNotNull(), F.struct(F.lit(kind).alias("type"), detail.alias("detail"))
        )

    arrow = lambda f: F.concat_ws(
        " -> ",
        F.coalesce(p(f).cast("string"), F.lit("null")),
        F.coalesce(c(f).cast("string"), F.lit("null")),
    )
    specific = F.array_compact(
        F.array(
            change("rank", F.when(player & differs("rank"), arrow("rank"))),
            change("points", F.when(player & differs("points"), arrow("points"))),
            change("results", results),
            change("nextGame", game),
        )
    )
    newer = differs("data_key") & F.coalesce(c("updated_at") > p("updated_at"), F.lit(False))
    generic = F.when(newer, F.array(F.struct(F.lit("data").alias("type"), F.lit("newer").alias("detail"))))
    rows = joined.select(key, specific.alias("_s"), generic.alias("_g"))
    chosen = F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("_g"))
    return rows.select(key, F.explode(chosen).alias("x")).select(key, "x.type", "x.detail")


# --- archive tables ------------------------------------------------------------------------------

_TABLE = ["season_key", "rows_hash", "title", "family", "partition", "n_rows"]
UNKNOWN_TITLE = "unbekannt"  # fixed value: title of tables without a name


def _use_up(tables: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """Pair eligible tables of both sides of each bucket in title order and take the pairs off.

    A side that the other one covers goes as a whole and a bucket without the other side stays as it
    is; only what is left over on the larger side needs an order. ``old`` tells the sides apart.
    """
    keys = ["season_key", "rows_hash", *by]
    of = lambda old: F.sum(F.when(F.col("old") == old, F.col("n")).otherwise(0))
    counts = tables.where(ok).groupBy(*keys).agg(of(True).alias("_l"), of(False).alias("_r"))
    both = counts.where((F.col("_l") > 0) & (F.col("_r") > 0))
    queued = dealt_join(tables.where(ok), both, keys, ["title"], "left")
    own = F.when(F.col("old"), F.col("_l")).otherwise(F.col("_r"))
    pairs = F.least("_l", "_r")
    lone = queued.where(pairs.isNull()).select(*tables.columns)
    larger = queued.where(own > pairs).select(*tables.columns, pairs.alias("_pairs"))
    placed = with_position(larger, keys, ["title", "n_rows"], {"_upto": F.col("n")}, "_pos")
    kept = placed.withColumn("n", F.least("n", F.greatest(F.col("_upto") - F.col("_pairs"), F.lit(0))))
    kept = kept.where(F.col("n") > 0).select(*tables.columns)
    return tables.where(~ok).unionByName(lone).unionByName(kept)


def match_archive_tables(previous: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays unmatched of the previous and the candidate tables after three passes.

    Tables have season_key, rows_hash, title, family, partition and n_rows. Every pass pairs
    tables of one season with equal rows: (1) the same title, (2) the same explicit family without
    a structural part on either side, (3) a previous unknown title with any family. Equal tables
    are one row with a count ``n`` from the start, so many copies cost no more than one.
    """
    count = lambda df: df.groupBy(*_TABLE).agg(F.count(F.lit(1)).alias("n"))
    left, right = count(previous), count(candidate)
    same = ["season_key", "rows_hash", "title", "n_rows"]
    taken = left.select(*same, F.col("n").alias("_l")).join(
        right.select(*same, F.col("n").alias("_r")), same
    ).select(*same, F.least("_l", "_r").alias("_pairs"))

    def minus(df: DataFrame) -> DataFrame:
        out = df.join(taken, same, "left")
        out = out.withColumn("n", F.col("n") - F.coalesce("_pairs", F.lit(0)))
        return out.where(F.col("n") > 0).drop("_pairs").select(*_TABLE, "n")

    both = minus(left).withColumn("old", F.lit(True)).unionByName(
        minus(right).withColumn("old", F.lit(False))
    )
    plain = F.coalesce(F.col("family").isNotNull() & ~F.col("partition"), F.lit(False))
    rest = _use_up(cut_lineage(both, "archive-tables"), ["family"], plain)
    unknown = F.coalesce(F.col("title") == UNKNOWN_TITLE, F.lit(False))
    rest = _use_up(rest, [], F.when(F.col("old"), unknown).otherwise(plain))
    return rest.where("old").drop("old"), rest.where("not old").drop("old")


def check_tables_no_loss(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """Titles that lost tables or rows, among the tables no pass could match.

    The tables of a season and title are compared by size, largest first: for every size there
    must be at least as many candidate tables of that size or more.
    """
    left, right = match_archive_tables(previous, candidate)
    keys = ["season_key", "title"]
    zero = F.lit(0).cast("bigint")
    sizes = (
        left.select(*keys, "n_rows", F.col("n").alias("_l"), zero.alias("_r"))
        .unionByName(right.select(*keys, "n_rows", zero.alias("_l"), F.col("n").alias("_r")))
        .groupBy(*keys, "n_rows")
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    # One row per distinct size of a title.
    larger = Window.partitionBy(*keys).orderBy(F.col("n_rows").desc())
    upto = larger.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    compared = sizes.withColumn("_cl", F.sum("_l").over(upto)).withColumn(
        "_cr", F.sum("_r").over(upto)
    )
    out = compared.groupBy(*keys).agg(
        (F.sum("_r") < F.sum("_l")).alias("_fewer"),
        F.bool_or((F.col("_l") > 0) & (F.col("_cr") < F.col("_cl"))).alias("_smaller"),
    )
    reason = F.when(F.col("_fewer"), "table count").when(F.col("_smaller"), "row count")
    return out.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())
