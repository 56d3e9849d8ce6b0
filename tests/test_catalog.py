"""Catalog sources, statistics row counts (P1, P4) and bucketed publishing."""

import pytest

from starmart.errors import UnknownTableError
from starmart.operators import profile
from starmart.plans import tpch_mart as M
from starmart.session import scratch_path
from starmart.sinks.catalog import ensure_database, publish_to_catalog, rollup_published
from starmart.sources.tables import CatalogSource, load_tables
from starmart.spec import Fact, MartSpec

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def db(spark):
    name = "starmart_catalog_test"
    ensure_database(spark, name, scratch_path(spark, "wh") + "/" + name)
    t = load_tables(spark, SF_SMALL)
    t["region"].write.format("parquet").saveAsTable(f"{name}.region")
    t["nation"].write.format("parquet").saveAsTable(f"{name}.nation")
    spark.sql(f"CREATE OR REPLACE VIEW {name}.region_names AS SELECT r_name FROM {name}.region")
    t["nation"].createOrReplaceTempView("nation_tmp")
    return name


def test_catalog_source_lists_base_tables_sorted(spark, db):
    src = CatalogSource(spark, db)
    assert list(src) == ["nation", "region"]
    assert src["region"].count() == 5
    with pytest.raises(UnknownTableError):
        src["region_names"]


def test_empty_database(spark):
    ensure_database(spark, "starmart_empty", scratch_path(spark, "wh") + "/empty")
    assert list(CatalogSource(spark, "starmart_empty")) == []


def test_stats_row_counts_null_until_analyzed(spark, db):
    before = {r.table_name: r.row_count for r in profile.stats_row_counts(spark, ["region", "nope"], db).collect()}
    assert before == {"region": None, "nope": None}
    after = {r.table_name: r.row_count
             for r in profile.stats_row_counts(spark, ["region", "nation", "nope"], db, analyze=True).collect()}
    assert after == {"region": 5, "nation": 25, "nope": None}


def test_bucketed_join_has_no_shuffle_under_it(spark):
    t = load_tables(spark, SF_SMALL)
    fact = Fact("fact_orders_monthly", ("orders",), (M.REVENUE, M.ORDER_COUNT), ("o_custkey",),
                key_map={"o_custkey": "dim_customer_geo"}, time_column="o_orderdate", time_grain="monthly")
    spec = MartSpec("geo", (fact,), (M.DIM_CUSTOMER_GEO,))
    publish_to_catalog(spec, t, "starmart_bucketed", scratch_path(spark, "wh") + "/bucketed", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = rollup_published(spark, spec, "starmart_bucketed", "fact_orders_monthly", ["r_name"],
                              grain="yearly", broadcast_rows=0, tables=t)
        plan = df._jdf.queryExecution().executedPlan().toString()
        join_subtree = plan[plan.index("SortMergeJoin"):]
        assert "Exchange" not in join_subtree
        assert "Bucketed: true" in join_subtree
        got = {(r.r_name, r.period): r.order_count for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(got.values()) == t["orders"].count()


def test_published_tables_have_statistics(spark):
    t = load_tables(spark, SF_SMALL)
    spec = MartSpec("m", (), (M.DIM_CUSTOMER,))
    views = publish_to_catalog(spec, t, "starmart_stats", scratch_path(spark, "wh") + "/stats", buckets=2,
                               run_id="r1")
    physical = list(views.values())[0].split(".")[-1].strip("`")
    counts = {r.table_name: r.row_count for r in profile.stats_row_counts(spark, [physical], "starmart_stats").collect()}
    assert counts[physical] == t["customer"].count()


def test_answer_published_bucketed_without_shuffle(spark):
    from starmart.queries import SEGMENT_GEO_MART
    from starmart.sinks.catalog import answer_published
    from starmart.spec import Intent
    t = load_tables(spark, SF_SMALL)
    publish_to_catalog(SEGMENT_GEO_MART, t, "starmart_seg_test", scratch_path(spark, "wh") + "/seg", buckets=4)
    intent = Intent(("total_revenue", "order_count"), ("r_name", "c_mktsegment"),
                    filters={"c_mktsegment": "AUTOMOBILE"}, time_granularity="yearly")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = answer_published(spark, intent, SEGMENT_GEO_MART, "starmart_seg_test", "fact_orders_monthly",
                              tables=t, broadcast_rows=0)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    below_joins = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in below_joins and below_joins.count("Bucketed: true") >= 3
    assert rows and {r.c_mktsegment for r in rows} == {"AUTOMOBILE"}
    direct = star_rollup_direct(t, intent)
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == direct


def star_rollup_direct(t, intent):
    from starmart.operators.star import answer
    from starmart.queries import SEGMENT_GEO_MART
    df = answer(intent, SEGMENT_GEO_MART, t, fact_name="fact_orders_monthly")
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_publish_layout(spark):
    """Dimensions and facts under the run folder, the grained fact partitioned
    by period, the check report saved, the run logged as current."""
    import os
    from starmart.sinks.publish import current_mart, publish_mart
    t = load_tables(spark, SF_SMALL)
    spec = MartSpec("m", (M.FACT_ORDERS_MONTHLY,), (M.DIM_CUSTOMER, M.DIM_CUSTOMER_GEO))
    root = scratch_path(spark, "layout")
    mart = publish_mart(spec, t, root, run_id="r1")
    assert current_mart(spark, root).run_id == "r1"
    assert set(mart.tables) == {"dim_customer", "dim_customer_geo", "fact_orders_monthly"}
    fact_dir = mart.path("fact_orders_monthly")
    if fact_dir.startswith("/"):
        assert any(d.startswith("period=") for d in os.listdir(fact_dir))
    fact = spark.read.parquet(fact_dir)
    assert fact.where("period = '1995-01-01'").count() > 0  # partition filter
    assert spark.read.json(f"{root}/r1/_checks").where("not passed").count() == 0
