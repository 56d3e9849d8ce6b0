"""Plan-shape tests: the scale decisions stay in the physical plans."""

import re

import pytest

import __spark_entry__ as E
from starmart.operators import checks, profile
from starmart.operators.star import star_rollup
from starmart.plans import tpch_mart as M
from starmart.sources.tables import load_tables

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return load_tables(spark, SF_SMALL)


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_filter_pushed_and_columns_pruned(spark):
    df = E.queries()["star_rollup"](spark, SF_SMALL)
    plan = _physical(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert all("o_orderpriority" not in s and "c_name" not in s for s in scans)


def test_year_from_is_a_pushed_range(spark):
    plan = _physical(E.queries()["filter_year_from"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in plan


def test_large_dimension_plan_aggregates_before_joining(tables):
    df = star_rollup(M.FACT_ORDERS, tables, M.SALES_MART, ["r_name"], grain="monthly", broadcast_rows=0)
    plan = _optimized(df)
    join_at = plan.index("Join LeftOuter")
    # an Aggregate over the orders rows sits below the first (outermost) join
    assert "Aggregate [period" in plan[join_at:]


def test_small_dimension_plan_broadcasts_and_aggregates_once(tables):
    df = star_rollup(M.FACT_ORDERS, tables, M.SALES_MART, ["r_name"], grain="monthly")
    plan = _physical(df)
    assert "BroadcastHashJoin" in plan
    assert plan.count("partial_sum(cast(o_totalprice") == 1


def test_sample_values_prelimit_before_shuffle(tables):
    df = profile.sample_values(tables["customer"], ["c_name", "c_mktsegment"])
    plan = _physical(df)
    assert "MapInPandas" in plan or "PythonMapInArrow" in plan
    assert "WindowGroupLimit" in plan


def test_relationship_strategies(tables):
    small = checks.relationship_violations(tables["orders"], "o_custkey", tables["customer"], "c_custkey")
    large = checks.relationship_violations(tables["orders"], "o_custkey", tables["customer"], "c_custkey",
                                           broadcast_rows=0)
    assert "LeftAnti" in _optimized(small)
    opt = _optimized(large)
    assert "LeftAnti" not in opt and "LeftOuter" in opt
    # child keys are aggregated before the join
    assert opt.index("Join LeftOuter") < opt.rindex("Aggregate [o_custkey")


def test_no_python_udf_in_fact_builds(spark):
    for name in ("fact_orders", "fact_lineitem_expr", "fact_multi_source", "grain_monthly", "check_report"):
        plan = _physical(E.queries()[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_target_schemas_run_no_job(spark, tables):
    """Target schemas come from analysis only."""
    from starmart.plans.schema import target_schemas
    for n in M.SALES_MART.source_tables():
        tables[n].schema  # Parquet schema inference reads footers with a job of its own
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    target_schemas(M.SALES_MART, tables)
    assert len(tracker.getJobIdsForGroup()) == before
