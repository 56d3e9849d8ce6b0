"""Every registered query against its DuckDB oracle (same gate as the driver)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

from starmart.oracle import ORACLE_SQL as ORACLE  # noqa: E402
from starmart.queries import registry  # noqa: E402

QUERIES = registry()  # the training-data operators have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert sorted(df.columns) == ["order_count", "period", "r_name", "total_revenue"]
