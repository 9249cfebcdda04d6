"""Every registered query against its SQL on the tables of scale 0.01."""
from __future__ import annotations

import pytest

from noisefleet.plans import registry
from tools.compare import check, connect

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, line = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, line


@pytest.mark.parametrize("name", ["rank_sites", "nearest_snow", "nearest_stations", "filter_exclusions", "gaps", "wx_apply", "compliance_matrix", "compare_sites"])
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
