"""Every registered query equals its oracle SQL on the smallest test data, by a plan without products or Python rows."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect
from paths import SMALL

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "InPandas"):
        assert word not in plan
    problem, _ = compare(spark, oracle, SMALL, lambda *_: df, ORACLES[name])
    assert problem is None, problem


def test_entry_runs(spark):
    assert len(entry.entry(spark).collect()) == 28
