"""Plans and operators that must hold on hot keys."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leaguelab import plans
from leaguelab.operators import history
from leaguelab.operators import matches as M
from leaguelab.operators.lookups import dealt_join, lookup
from leaguelab.operators.ordering import with_position
from leaguelab.operators.medians import bin_of, weighted_medians
from leaguelab.plans import roles

plans.load_all()
FOLDER = "/root/testdata/sf0.001"
# Keys with a handful of values: unaggregated rows must never be dealt out by them alone.
HOT = {"season_start", "season_end", "cutoff", "target_ord", "class_ord", "edge", "flag", "club_no"}


def hot_exchanges(plan: str) -> list[str]:
    """Exchanges by hot keys whose rows are not aggregated before."""
    lines = [x for x in plan.split("\n") if x.strip()]
    depth = [len(re.match(r"[ :|+\-*()\d]*", x).group()) for x in lines]
    found = []
    for n, line in enumerate(lines):
        keys = re.search(r"Exchange hashpartitioning\((.*?), \d+\)", line)
        if not keys:
            continue
        names = {re.sub(r"#\d+L?$", "", k.strip()) for k in keys.group(1).split(",")}
        if not names <= HOT:
            continue
        below = [x for x, d in zip(lines[n + 1 :], depth[n + 1 :]) if d >= depth[n]]
        first = next(
            (x for x in below if not re.search(r"Project|Filter|Sort |AQEShuffleRead|InputAdapter", x)), ""
        )
        if not re.search(r"Aggregate|Window", first):
            found.append(line.strip())
    return found


@pytest.mark.parametrize(
    "name",
    ["M2_stabilize", "M3_class_calibration", "M4_convert_rating", "M5_target_mean", "M6_historical_prior",
     "M18_backtest", "A19_backtest_metrics", "W12_capped_weights", "W13_weighted_median",
     "M9_team_roster", "J13_J14_roster_vetoes"],
)
def test_no_row_is_dealt_by_season_cutoff_class_or_edge(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.QUERIES[name](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in plan and not hot_exchanges(plan)
    assert "rangepartitioning" not in plan


def test_hot_exchanges_are_recognised():
    bad = "+- Exchange hashpartitioning(cutoff#1, edge#2L, 8), X\n   +- Project [a]\n      +- FileScan parquet"
    good = "+- Exchange hashpartitioning(cutoff#1, 8), X\n   +- HashAggregate(keys=[cutoff#1])\n      +- FileScan"
    assert hot_exchanges(bad) and not hot_exchanges(good)


def plain_median(rows):
    """(median, total) of (value, weight) rows."""
    rank = lambda r: (math.isnan(r[0]), r[0])
    rows, total, run = sorted((r for r in rows if r[0] is not None), key=rank), 0, 0
    total = sum(w for _, w in rows)
    for value, weight in rows:
        run += weight
        if 2 * run >= total:
            return value, total
    return None


def test_weighted_medians_equal_brute_force(spark):
    rng = random.Random(5)
    odd = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, math.inf, -math.inf, math.nan, 5e-324]
    rows = []
    for g in range(60):
        near = [rng.choice([1.0, -2.5]) * (1 + rng.random() / 10**g) for _ in range(rng.randint(1, 60))]
        values = rng.choice([near, odd, [rng.uniform(-3, 3) for _ in range(40)], [7.25] * 9, [0.5, None]])
        rows += [(g if g else None, v, rng.randint(0, 3) if g % 7 else 0) for v in values]
    df = spark.createDataFrame(rows, "g int, v double, w int").repartition(7)
    found = {r["g"]: (r["median"], r["total_weight"]) for r in weighted_medians(df, ["g"], "v", "w").collect()}
    groups = {g for g, *_ in rows}
    want = {g: plain_median([(v, w) for x, v, w in rows if x == g]) for g in groups}
    plain = lambda r: ("nan" if math.isnan(r[0]) else r[0], r[1])
    assert {g: plain(v) for g, v in found.items()} == {g: plain(v) for g, v in want.items() if v is not None}


def test_capped_medians_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(g, rng.gauss(0, 1), rng.choice([1, 2, 3, 4, 50])) for g in range(12) for _ in range(g * 3 + 1)]
    found = weighted_medians(
        spark.createDataFrame(rows, "g int, v double, w int").repartition(5), ["g"], "v", "w", cap=True
    )
    for r in found.collect():
        mine = [(v, w) for g, v, w in rows if g == r["g"]]
        weights = sorted(w for _, w in mine)
        middle = weights[(len(weights) - 1) // 2]
        capped = [(v, min(w, 2 * middle)) for v, w in mine]
        assert (r["median"], r["total_weight"]) == plain_median(capped)
        assert (r["weight_median"], r["weight_cap"]) == (middle, 2 * middle)
        assert r["observations"] == len(mine) and r["raw_total_weight"] == sum(weights)
        assert r["capped"] == sum(w > 2 * middle for w in weights)
        assert (r["min_value"], r["max_value"]) == (min(mine)[0], max(mine)[0])


def test_bins_never_fall(spark):
    rng = random.Random(3)
    values = sorted([rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(2000)] + [0.0, 1.0, -1.0])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", bin_of(F.col("v")).alias("b"))
    bins = [b for _, b in sorted(map(tuple, df.collect()))]
    assert bins == sorted(bins) and len(set(bins)) > 1000


def test_lookup_values_null_keys_and_bound(spark):
    small = spark.createDataFrame(
        [(k, None if k == 3 else f"s{k}", k * 1.5) for k in range(700)] + [(None, "n", -1.0)],
        "a int, b string, v double",
    )
    rows = spark.createDataFrame(
        [(5, "s5"), (699, "s699"), (3, None), (None, "n"), (None, None), (5, "s6")], "a long, b string"
    )
    found = rows.withColumn("v", lookup(small, ["a", "b"], F.col("v"))("a", "b")).collect()
    assert [r["v"] for r in found] == [7.5, 1048.5, 4.5, -1.0, None, None]
    empty = rows.withColumn("v", lookup(small.where("a < 0"), ["a"], F.col("v"))("a")).collect()
    assert [r["v"] for r in empty] == [None] * 6
    with pytest.raises(Exception, match="more than 500 rows"):
        rows.withColumn("v", lookup(small, ["a", "b"], F.col("v"), max_rows=500)("a", "b")).collect()


def test_dealt_join_equals_the_plain_join(spark):
    """A hot key, a key without a partner, NULL keys, several rows a key on the small side."""
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5).alias("k"), "id"
    )
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "k long, v string")
    for how in ("inner", "left"):
        got = dealt_join(rows, few, ["k"], ["id"], how).select("k", "id", "v").collect()
        assert sorted(got, key=str) == sorted(rows.join(few, "k", how).select("k", "id", "v").collect(), key=str)


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_positions_and_running_sums_equal_brute_force(spark, by):
    rng = random.Random(11)
    # One group holds half of the rows; groups begin and end inside tasks, and some keys are NULL.
    rows = [
        (rng.choice([None, 1, 2, 3]) if rng.random() < 0.5 else 7, rng.choice([None, "a", "b"]), i, rng.choice([None, 0, 1, 5]))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "g int, h string, i int, v int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = with_position(df, by, [F.col("i").desc()], {"s": F.col("v")}, "p", totals=True).collect()
        plain = with_position(df, by, [F.col("i").desc()], name="p").collect()
    finally:
        for key in ("shuffle.partitions", "adaptive.coalescePartitions.enabled", "execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = {}
    for g, h, i, v in sorted(rows, key=lambda r: -r[2]):
        groups.setdefault(tuple({"g": g, "h": h}[c] for c in by), []).append((g, h, i, v))
    want = {}
    for members in groups.values():
        run, total = 0, sum(r[3] or 0 for r in members)
        for n, (g, h, i, v) in enumerate(members, 1):
            run += v or 0
            want[i] = (g, h, i, v, n, run, len(members), total)
    assert {r["i"]: tuple(r) for r in found} == want
    assert {r["i"]: r["p"] for r in plain} == {i: w[4] for i, w in want.items()}


def test_positions_of_nothing(spark):
    df = spark.createDataFrame([], "g int, i int")
    assert with_position(df, ["g"], ["i"], {"s": F.col("i")}, totals=True).collect() == []
    assert with_position(df, [], ["i"]).collect() == []


def test_history_of_two_seasons_is_read_from_their_folders(spark):
    df = plans.QUERIES["S4_seasons_written_and_read"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [season_start#" in plan and "IN (" in plan.split("PartitionFilters:")[1][:80]
    assert df.select("season_start").distinct().count() == 2


def test_cup_lines_of_clubs(spark):
    rows = [(1, "TSV Hamburg 2", "Kiel"), (2, "Kiel", "Bremen"), (3, "Lübeck", "TSV Hamburg"), (4, "A", "B"),
            (5, "TSV Hamburg", "TSV Hamburg 2"), (5, "TSV Hamburg", "TSV Hamburg 2")]
    clubs = spark.createDataFrame([("TSV Hamburg e.V.",), ("tsv hamburg",)], "club string")
    parsed = spark.createDataFrame(rows, "n int, home string, away string")
    assert sorted(r["n"] for r in M.cup_lines_of_clubs(parsed, clubs).collect()) == [1, 3, 5, 5]
    assert M.cup_lines_of_clubs(parsed, clubs.limit(0)).collect() == []


def test_state_rows_are_never_broadcast(spark):
    """A written table of hashes is larger than its files, so what grows with it meets by a merge."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = plans.QUERIES["Q16_check_state"](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.split("\n") if x.strip()]
    depth = [len(re.match(r"[ :|+\-*()\d]*", x).group()) for x in lines]
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            assert not re.search(r"\b(uid|round_name)#", "\n".join(lines[n:below]))
    assert "SortMergeJoin" in plan


def test_cup_lines_are_read_once_for_names_and_result(spark):
    """Neither the lines nor what is asked of a name is computed again behind the written tables."""
    texts = [(n, f"06.09.2025 20:00 {a} - Gast {n} 3:1") for n, a in enumerate(["Ring Nord", "Haus Süd", "Ring Nord 2"])]
    parsed = M.parse_cup_lines(spark.createDataFrame(texts, "n int, line string"))
    clubs = spark.createDataFrame([("Ring Nord",)], "club string")
    kept = M.cup_lines_of_clubs(parsed, clubs)
    assert kept.columns == parsed.columns
    assert sorted(r["n"] for r in kept.collect()) == [0, 2]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp|rlike|array_join|Generate|pythonUDF", plan, re.I)


def test_history_rows_move_by_player_and_without_ids(spark):
    """A segment's id is 71 letters that no codec makes smaller; rows of a season move with its player."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = roles.segment_rounds(spark, FOLDER)
        usable = history.usable_history(history.build_segments(long), long).drop("segment_id")
        plan = usable._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\(player_id#\d+L?, season_start#\d+, \d+\)", plan)
    assert "REPARTITION" not in plan
    lined = plans.QUERIES["J8_J17_lined_up_matches"](spark, FOLDER)
    assert "segment_id" not in lined._jdf.queryExecution().executedPlan().toString()
