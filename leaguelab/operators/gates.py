"""Publication gates: each turns a candidate into one decision row.

A decision row is ``domain, decision, effective_season, reasons, metrics``; reasons and metrics
hold one short entry per rule, never one per data row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_cup
from ..functions.classes import CLASSES, required_category
from ..functions.seasons import canonical_season, clean, trailing_season
from ..functions.text import squeeze

PUBLISH, RETAIN, BLOCKED, FAILED = "publish", "retain", "blocked", "failed"
# Domains in report order, and the limits of the gates.
DOMAINS = ["leagues", "rankings", "clubs", "archives"]
MIN_LEAGUES, MATCHDAYS, MIN_COLUMNS, MIN_CLUB_RATIO = 13, 18, 9, 0.80
NO_SEASON = "unknown"


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def _metrics(**values: Column) -> Column:
    items: list[Column] = []
    for name, value in values.items():
        items += [F.lit(name), F.coalesce(value, F.lit(0)).cast("bigint")]
    return F.create_map(*items)


def _decision(domain: str, decision: Column, season: Column, reasons: Column, metrics: Column):
    return [
        F.lit(domain).alias("domain"),
        decision.alias("decision"),
        season.alias("effective_season"),
        reasons.alias("reasons"),
        metrics.alias("metrics"),
    ]


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two one-row aggregates side by side; the second is a scalar subquery."""
    row = other.select(F.struct(*other.columns)).scalar()
    return one.withColumn("_row", row).select(*one.columns, "_row.*")


def _blank(c: Column) -> Column:
    return F.coalesce(squeeze(c), F.lit("")) == ""


def gate_rankings(
    players: DataFrame, tables: DataFrame, season: Column, previous_season: Column
) -> DataFrame:
    """Gate of the current rankings.

    ``players``: id, name, league. ``tables``: category, issue (NULL = usable, 'empty' = blank,
    'malformed', 'unsafe'). Any bad row, label, duplicate, table or season conflict blocks; a class
    without players or without a table retains the previous data; no season blocks.
    """
    rows = players.select(
        F.col("id"), F.col("name"), required_category(F.col("league")).alias("c")
    )
    bad = _blank(F.col("id")) | _blank(F.col("name")) | F.col("c").isNull()
    marked = rows.withColumn("_bad", bad)
    # One row per class and id first, so that a hot id is combined early.
    per_id = marked.groupBy(
        "_bad", F.col("c.class").alias("class"), F.when(~F.col("_bad"), clean(F.col("id"))).alias("_id")
    ).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("c").isNull()).alias("_bad_label"),
        F.collect_set("c.season").alias("_seasons"),
        F.count("c.season").alias("_suffixes"),
        F.count_if(F.col("c.season") != canonical_season(season, strict=True)["key"]).alias("_off"),
    )
    facts = per_id.agg(
        F.coalesce(F.sum(F.when(F.col("_bad"), F.col("_n"))), F.lit(0)).alias("invalid_players"),
        F.coalesce(F.sum("_bad_label"), F.lit(0)).alias("invalid_labels"),
        F.coalesce(F.sum(F.when(~F.col("_bad"), F.col("_n") - 1)), F.lit(0)).alias("duplicates"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("_bad"), F.col("_seasons"))))).alias("s1"),
        F.coalesce(F.sum(F.when(~F.col("_bad"), F.col("_off"))), F.lit(0)).alias("off1"),
        *[
            F.count_if((F.col("class") == name) & ~F.col("_bad")).alias(f"n_{i}")
            for i, name in enumerate(CLASSES)
        ],
    )
    cats = tables.select(required_category(F.col("category")).alias("c"), "issue")
    per_class = cats.groupBy(F.col("c.class").alias("class")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("issue") == "malformed").alias("_malformed"),
        F.count_if(F.col("issue") == "unsafe").alias("_unsafe"),
        F.bool_or(F.col("issue").isNull()).alias("_ready"),
        F.collect_set("c.season").alias("_seasons"),
        F.count_if(F.col("c.season") != canonical_season(season, strict=True)["key"]).alias("_off"),
    )
    known = F.col("class").isNotNull()
    table_facts = per_class.agg(
        F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("bad_categories"),
        F.coalesce(F.sum(F.when(known, F.col("_n") - 1)), F.lit(0)).alias("double_categories"),
        F.coalesce(F.sum(F.when(known, F.col("_malformed"))), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum(F.when(known, F.col("_unsafe"))), F.lit(0)).alias("unsafe"),
        F.array_distinct(F.flatten(F.collect_set("_seasons"))).alias("s2"),
        F.coalesce(F.sum("_off"), F.lit(0)).alias("off2"),
        *[
            F.coalesce(F.bool_or((F.col("class") == name) & F.col("_ready")), F.lit(False)).alias(
                f"t_{i}"
            )
            for i, name in enumerate(CLASSES)
        ],
    )
    one = _beside(facts, table_facts)
    parsed = canonical_season(season, strict=True)["key"]
    seasons = F.size(F.array_union("s1", "s2"))
    one = one.withColumn("_season", parsed).withColumn("_previous", previous_season)
    one = one.withColumn(
        "_blocking",
        _reasons(
            (F.col("invalid_players") > 0, "invalid players"),
            (F.col("invalid_labels") > 0, "invalid player labels"),
            (F.col("duplicates") > 0, "duplicate players"),
            (~_blank(season) & F.col("_season").isNull(), "invalid season"),
            (F.col("bad_categories") > 0, "invalid table labels"),
            (F.col("double_categories") > 0, "duplicate categories"),
            (F.col("malformed") > 0, "malformed tables"),
            (F.col("unsafe") > 0, "unsafe tables"),
            (seasons > 1, "conflicting seasons"),
            (F.col("off1") + F.col("off2") > 0, "season mismatch"),
        ),
    ).withColumn(
        "_missing",
        _reasons(
            *[
                ((F.col(f"n_{i}") == 0) | ~F.col(f"t_{i}"), f"missing class {name}")
                for i, name in enumerate(CLASSES)
            ]
        ),
    )
    blocked, missing = F.size("_blocking") > 0, F.size("_missing") > 0
    none = F.col("_season").isNull()
    return one.select(
        *_decision(
            "rankings",
            F.when(blocked, BLOCKED).when(missing, RETAIN).when(none, BLOCKED).otherwise(PUBLISH),
            F.when(blocked | missing | none, F.col("_previous")).otherwise(F.col("_season")),
            F.when(blocked, F.col("_blocking"))
            .when(missing, F.col("_missing"))
            .when(none, F.array(F.lit("season is missing")))
            .otherwise(F.array().cast("array<string>")),
            _metrics(
                invalid_players=F.col("invalid_players"), duplicates=F.col("duplicates"),
                **{name: F.col(f"n_{i}") for i, name in enumerate(CLASSES)},
            ),
        )
    )


def league_table_issues(cells: DataFrame) -> DataFrame:
    """First problem of each league table ``(league, row_no, cells)``; row 0 is the header."""
    team = F.lower(squeeze(F.coalesce(F.get("cells", F.lit(1)), F.lit(""))))
    rows = cells.select("league", "row_no", F.size("cells").alias("_w"), team.alias("_team"))
    body = F.col("row_no") > 0
    real = body & (F.col("_team") != "spielfrei")  # fixed value: label of a bye row
    per_team = rows.groupBy("league", "_team").agg(
        F.count_if(real).alias("_n"),
        F.max(F.when(~body, F.col("_w"))).alias("_head"),
        F.min(F.when(body, F.col("_w"))).alias("_lo"),
        F.max(F.when(body, F.col("_w"))).alias("_hi"),
        F.count_if(body & (F.col("_team") == "")).alias("_blank"),
    )
    facts = per_team.groupBy("league").agg(
        F.max("_head").alias("_head"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.sum("_blank").alias("_blank"), F.max("_n").alias("_most"), F.sum("_n").alias("_teams"),
    )
    issue = (
        F.when(F.col("_head").isNull(), "table has no header")
        .when(F.col("_head") < MIN_COLUMNS, "too few columns")
        .when((F.col("_lo") != F.col("_head")) | (F.col("_hi") != F.col("_head")), "inconsistent columns")
        .when(F.col("_blank") > 0, "blank team name")
        .when(F.col("_most") > 1, "duplicate team name")
        .when(F.coalesce("_teams", F.lit(0)) == 0, "table has no team")
    )
    return facts.select("league", issue.alias("table_issue"))


def matchday_issues(lines: DataFrame) -> DataFrame:
    """First problem of the matchdays of each league.

    ``lines``: league, round_name, line; a round without text has the line '---'.
    """
    number = F.regexp_extract("round_name", r"(?i)^\s*(\d+)\.\s*Spieltag\s*$", 1).try_cast("bigint")
    dated = F.col("line").rlike(r"\d{1,2}\.\s*\d{1,2}\.\s*\d{4}")
    undated = ~dated & (clean(F.col("line")) != "") & (F.col("line") != "---")
    per_round = lines.groupBy("league", "round_name").agg(
        F.max(number).alias("_no"), F.bool_or(undated).alias("_undated")
    )
    facts = per_round.groupBy("league").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_no").isNull()).alias("_bad"),
        F.count_distinct("_no").alias("_distinct"),
        F.min("_no").alias("_lo"), F.max("_no").alias("_hi"),
        F.bool_or("_undated").alias("_undated"),
    )
    issue = (
        F.when(F.col("_n") != MATCHDAYS, "number of matchdays")
        .when(F.col("_bad") > 0, "invalid matchday label")
        .when(F.col("_distinct") != F.col("_n"), "duplicate matchday number")
        .when(F.col("_undated"), "line without date")
        .when((F.col("_lo") != 1) | (F.col("_hi") != MATCHDAYS), "matchday sequence")
    )
    return facts.select("league", issue.alias("matchday_issue"))


def gate_leagues(
    leagues: DataFrame, tables: DataFrame, matchdays: DataFrame, explicit_season: Column,
    previous_season: Column,
) -> DataFrame:
    """Gate of the league snapshot: ``leagues`` (league), table issues and matchday issues."""
    named = leagues.select("league", trailing_season(F.col("league")).alias("s")).where(
        ~is_cup(F.col("league"))
    )
    newest = named.agg(F.max("s.start")).scalar()
    current = named.where(F.col("s.start") == newest)
    no_table = F.coalesce("table_issue", F.when(F.col("has_table").isNull(), "no table"))
    joined = (
        current.join(tables.withColumn("has_table", F.lit(1)), "league", "left")
        .join(matchdays.withColumn("has_days", F.lit(1)), "league", "left")
        .withColumn("_t", no_table)
        .withColumn(
            "_d", F.coalesce("matchday_issue", F.when(F.col("has_days").isNull(), "no matchdays"))
        )
    )
    per_key = joined.groupBy(F.lower(squeeze(F.col("league"))).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("s.key").alias("_season"),
        F.count_if(F.col("_t").isNotNull()).alias("_bad_t"),
        F.count_if(F.col("_d").isNotNull()).alias("_bad_d"),
    )
    facts = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("double"),
        F.max("_season").alias("season"),
        F.coalesce(F.sum("_bad_t"), F.lit(0)).alias("bad_tables"),
        F.coalesce(F.sum("_bad_d"), F.lit(0)).alias("bad_matchdays"),
    ).withColumn("_explicit", canonical_season(explicit_season, strict=True)["key"])
    given = explicit_season.isNotNull()
    reasons = (
        F.when(F.col("season").isNull(), F.array(F.lit("no season")))
        .when(given & F.col("_explicit").isNull(), F.array(F.lit("invalid season")))
        .when(given & (F.col("_explicit") != F.col("season")), F.array(F.lit("not the newest season")))
        .otherwise(
            _reasons(
                (F.col("double") > 0, "duplicate leagues"),
                (F.col("n") < MIN_LEAGUES, "too few leagues"),
                (F.col("bad_tables") > 0, "bad tables"),
                (F.col("bad_matchdays") > 0, "bad matchdays"),
            )
        )
    )
    blocked = F.size("_r") > 0
    return facts.withColumn("_r", reasons).select(
        *_decision(
            "leagues",
            F.when(blocked, BLOCKED).otherwise(PUBLISH),
            F.when(blocked, previous_season).otherwise(F.col("season")),
            F.col("_r"),
            _metrics(
                regular_leagues=F.col("n"), bad_tables=F.col("bad_tables"),
                bad_matchdays=F.col("bad_matchdays"),
            ),
        )
    )


def _club_facts(clubs: DataFrame, prefix: str) -> DataFrame:
    key = F.lower(squeeze(F.coalesce(F.col("number"), F.lit(""))))
    per_number = clubs.groupBy(key.alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(_blank(F.col("name"))).alias("_blank")
    )
    return per_number.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias(f"{prefix}_n"),
        F.coalesce(F.sum(F.when(F.col("_k") != "", F.col("_n") - 1)), F.lit(0)).alias(f"{prefix}_double"),
        F.coalesce(F.sum("_blank"), F.lit(0)).alias(f"{prefix}_name"),
        F.coalesce(F.sum(F.when(F.col("_k") == "", F.col("_n"))), F.lit(0)).alias(f"{prefix}_number"),
    )


def gate_clubs(
    candidate: DataFrame, previous: DataFrame, season: Column, previous_season: Column
) -> DataFrame:
    """Gate of the clubs: unique numbers, names, and at least 80 % of the previous count."""
    one = _beside(_club_facts(candidate, "c"), _club_facts(previous, "p"))
    reasons = _reasons(
        (F.col("p_name") + F.col("p_number") + F.col("p_double") > 0, "previous clubs"),
        (F.col("c_name") > 0, "blank name"),
        (F.col("c_number") > 0, "blank number"),
        (F.col("c_double") > 0, "duplicate number"),
        (F.col("c_n") == 0, "empty"),
        (
            (F.col("c_n") > 0) & (F.col("c_n") < F.col("p_n") * F.lit(MIN_CLUB_RATIO)),
            "too few clubs",
        ),
    )
    blocked = F.size("_r") > 0
    parsed = canonical_season(season, strict=True)["key"]
    return one.withColumn("_r", reasons).select(
        *_decision(
            "clubs",
            F.when(blocked, BLOCKED).otherwise(PUBLISH),
            F.when(blocked, previous_season).otherwise(F.coalesce(parsed, previous_season)),
            F.col("_r"),
            _metrics(clubs=F.col("c_n"), previous_clubs=F.col("p_n")),
        )
    )


def gate_seasons(candidate: DataFrame, previous: DataFrame, season: str = "season") -> DataFrame:
    """Gate of the archive seasons: every previous season must still be there."""

    def keyed(df: DataFrame, flag: str) -> DataFrame:
        per = df.select(season).distinct()
        key = canonical_season(F.col(season))["key"]
        return per.select(F.col(season).alias("_raw"), key.alias("_key"), F.lit(1).alias(flag))

    both = keyed(candidate, "_c").unionByName(keyed(previous, "_p"), allowMissingColumns=True)
    per_key = both.groupBy("_key").agg(
        F.count("_c").alias("_c"), F.count("_p").alias("_p")
    )
    known = F.col("_key").isNotNull()
    facts = per_key.agg(
        F.coalesce(F.sum(F.when(~known, F.col("_c") + F.col("_p"))), F.lit(0)).alias("invalid"),
        F.count_if(known & ((F.col("_c") > 1) | (F.col("_p") > 1))).alias("double"),
        F.count_if(known & (F.col("_p") > 0) & (F.col("_c") == 0)).alias("missing"),
        F.count_if(known & (F.col("_c") > 0)).alias("n_c"),
        F.count_if(known & (F.col("_p") > 0)).alias("n_p"),
        F.max(F.when(F.col("_c") > 0, F.col("_key"))).alias("newest_c"),
        F.max(F.when(F.col("_p") > 0, F.col("_key"))).alias("newest_p"),
    )
    reasons = _reasons(
        (F.col("invalid") > 0, "invalid season"),
        (F.col("double") > 0, "duplicate season"),
        (F.col("n_p") == 0, "empty previous archive"),
        (F.col("missing") > 0, "missing season"),
    )
    blocked = F.size("_r") > 0
    newest = F.when(blocked, F.col("newest_p")).otherwise(F.col("newest_c"))
    return facts.withColumn("_r", reasons).select(
        *_decision(
            "archives",
            F.when(blocked, BLOCKED).otherwise(PUBLISH),
            F.coalesce(newest, F.lit(NO_SEASON)),
            F.col("_r"),
            _metrics(
                candidate_seasons=F.col("n_c"), previous_seasons=F.col("n_p"),
                missing=F.col("missing"),
            ),
        )
    )


def run_decision(
    results: DataFrame, previous: DataFrame, changed: DataFrame, now: Column
) -> DataFrame:
    """Status of every domain after a run, and whether the run may publish.

    ``results``: domain, decision, effective_season. ``previous``: domain, season, state,
    updated_at. ``changed``: domains with new content. A changed publish becomes current now; a
    retained domain keeps season and time; everything else stays as it was.
    """
    allowed = F.coalesce(F.col("decision").isin(PUBLISH, RETAIN), F.lit(False))
    joined = previous.join(results, "domain", "left").join(
        changed.select("domain", F.lit(True).alias("_changed")), "domain", "left"
    )
    ready = joined.agg(F.bool_and(allowed)).scalar()
    fresh = (F.col("decision") == PUBLISH) & F.coalesce("_changed", F.lit(False))
    seasonal = F.col("domain").isin("leagues", "rankings")
    return joined.select(
        "domain",
        F.coalesce("decision", F.lit(FAILED)).alias("decision"),
        F.when(fresh & seasonal, F.col("effective_season")).otherwise(F.col("season")).alias("season"),
        F.when(fresh, "current")
        .when(F.col("decision") == RETAIN, "retained")
        .otherwise(F.col("state"))
        .alias("state"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"),
        ready.alias("ready"),
    )


def ranking_after_leagues(rankings: DataFrame, leagues: DataFrame) -> DataFrame:
    """Block the rankings when the league gate failed or names another season."""
    league = leagues.select(
        F.struct(F.col("decision").alias("_d"), F.col("effective_season").alias("_s"))
    ).scalar()
    joined = rankings.withColumn("_l", league).select("*", "_l.*")
    no_league = ~F.coalesce(F.col("_d").isin(PUBLISH, RETAIN), F.lit(False))
    other = (F.col("decision") == PUBLISH) & (F.col("effective_season") != F.col("_s"))
    reason = F.when(no_league, F.array(F.lit("league season is unavailable"))).when(
        other, F.array(F.lit("season differs from leagues"))
    )
    return joined.withColumn("_r", reason).select(
        "domain",
        F.when(F.col("_r").isNotNull(), BLOCKED).otherwise(F.col("decision")).alias("decision"),
        "effective_season",
        F.coalesce("_r", "reasons").alias("reasons"),
        "metrics",
    )


def effective(candidate: DataFrame, previous: DataFrame, results: DataFrame) -> DataFrame:
    """Data that count per ``domain``: the candidate if published, the previous if retained.

    Other decisions raise an error when the rows are read.
    """
    decisions = results.select("domain", "decision")
    checked = F.when(
        ~F.col("decision").isin(PUBLISH, RETAIN),
        F.raise_error(F.concat(F.lit("domain is not usable: "), F.col("domain"))).cast("string"),
    ).otherwise(F.col("decision"))
    known = decisions.select("domain", checked.alias("decision"))
    pick = lambda df, decision: df.join(
        known.where(F.col("decision") == decision).select("domain"), "domain", "left_semi"
    )
    return pick(candidate, PUBLISH).unionByName(pick(previous, RETAIN))


def single_season(leagues: DataFrame, name: str = "league") -> DataFrame:
    """One row: the number of seasons among the regular leagues and the season if there is one."""
    season = F.regexp_extract(F.col(name), r"(\d{4}-\d{4})", 1)
    seasons = leagues.where(~is_cup(F.col(name))).agg(
        F.count_distinct(F.nullif(season, F.lit(""))).alias("seasons"),
        F.max(F.nullif(season, F.lit(""))).alias("_s"),
        F.count_if(season == "").alias("without_season"),
    )
    ok = (F.col("seasons") <= 1) & (F.col("without_season") == 0)
    return seasons.select(
        "seasons", "without_season", F.when(ok, F.col("_s")).alias("season"), ok.alias("ok")
    )


def check_status(status: DataFrame, domains: Sequence[str] = tuple(DOMAINS)) -> DataFrame:
    """Broken rules of the status table: exactly the known domains, each once and complete."""
    facts = status.groupBy("domain").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(_blank(F.col("season"))).alias("_season"),
        F.bool_or(~F.coalesce(F.col("state").isin("current", "retained"), F.lit(False))).alias("_state"),
        F.bool_or(F.col("updated_at").isNull()).alias("_time"),
    )
    checks = _reasons(
        (~F.col("domain").isin(list(domains)), "unknown domain"),
        (F.col("_n") > 1, "duplicate domain"),
        (F.col("_season"), "season"),
        (F.col("_state"), "state"),
        (F.col("_time"), "updated_at"),
    )
    found = facts.select("domain", F.explode(checks).alias("reason"))
    present = status.agg(F.collect_set(F.when(F.col("domain").isin(list(domains)), F.col("domain"))).alias("_d"))
    wanted = F.array(*[F.lit(x) for x in domains])
    missing = present.select(F.explode(F.array_except(wanted, F.col("_d"))).alias("domain"))
    return found.unionByName(missing.withColumn("reason", F.lit("missing domain")))
