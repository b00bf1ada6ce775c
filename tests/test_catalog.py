"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from auctionlake.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    run, sql = CATALOG[name]
    if sql is None:
        assert run(spark, SF).columns
        assert run(spark, SF).count() > 0
    else:
        assert compare(spark, con, run, sql, SF) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
