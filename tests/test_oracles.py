"""Every query with SQL must give the SQL's rows (sf0.001 here; the driver uses a larger scale)."""

import pytest
from compare_with_sql import connect, difference

from ridgeline.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, con, name):
    assert difference(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
