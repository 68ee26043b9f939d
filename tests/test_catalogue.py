"""Every query of the catalogue against its SQL twin."""

import pytest

from quadrille.queries import ORACLES, QUERIES
from tests.util import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_filters_and_prune_columns(spark):
    plan = QUERIES["bgp_star"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan or "PushedFilters" in plan and "o_orderpriority" in plan
    assert "o_orderdate" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
