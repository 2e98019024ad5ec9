"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import compare

import __spark_entry__ as entry
from leaguelab import plans

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(plans.QUERIES)
# Quadratic or single-task operators that no plan may hold.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin"]


def _check(spark, name: str) -> tuple[str | None, list[str]]:
    build, sql = entry.queries()[name], entry.oracle_sql().get(name)
    plans: list[str] = []

    def traced(session, folder):
        df = build(session, folder)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    try:
        problem = compare(spark, FOLDER, traced, sql)
    except Exception as error:  # noqa: BLE001
        problem = f"{type(error).__name__}: {str(error)[:800]}"
    return problem, [f for f in FORBIDDEN for p in plans if f in p]


@pytest.fixture(scope="module")
def outcomes(spark):
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(lambda n: _check(spark, n), NAMES)))


def test_every_query_has_sql():
    assert set(plans.SQL) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(outcomes, name):
    problem, forbidden = outcomes[name]
    # A tiny data set may leave a result empty; then both sides are.
    assert problem in (None, "no rows"), problem
    assert not forbidden


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["season_start", "class", "round", "player_id"]
    assert df.count() > 0
