"""Every registered query against its SQL on the smallest tables."""

import pytest

from corpusmill.plans import load_all, registry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
load_all()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES  # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if key in ORACLES:
        diff, _ = compare(con, ORACLES[key], df)
        assert not diff, diff
    else:
        assert df.count() > 0
