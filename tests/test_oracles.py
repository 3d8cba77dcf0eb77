"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tests.harness import compare, connect
from veilgauge.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries()
MODELS = {"ml_forest", "ml_second", "ml_blend", "holdout", "eval_loco", "eval_loco_captures", "ml_convolution"}  # fitted on sf0.01 by tests.check


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in MODELS])
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, ORACLES[name], con) is None
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
