"""A published mart moves from run to run at once."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from starmart.operators.facts import read_columns
from starmart.plans.joins import _row_hash
from starmart.sinks import catalog
from starmart.sinks.catalog import answer_from_mart, current_run, publish_to_catalog, rollup_published
from starmart.spec import Dimension, Fact, Intent, MartSpec, Metric


def _shop(spark, run):
    """Run n: each order costs n, each area is named for n; from run 2 on areas have a size."""
    orders = spark.createDataFrame([(i, i % 3, float(run)) for i in range(9)], "order_id int, customer_id int, price double")
    customers = spark.createDataFrame([(i, f"area{run}", run * 10) for i in range(3)], "customer_id int, area string, size int")
    return {"orders": orders, "customers": customers}


def _spec(run):
    fact = Fact("orders_by", ("orders",), (Metric("revenue", "sum", "price"), Metric("n", "count")), ("customer_id",), key_map={"customer_id": "dim_customer"})
    plain = Fact("all_orders", ("orders",), (Metric("n_all", "count"),), ("order_id",))
    dim = Dimension("dim_customer", "customers", "customer_id", ("area",) if run == 1 else ("area", "size"))
    return MartSpec("the shop", (fact,) if run < 3 else (fact, plain), (dim,))


SEEN = {1: {("area1", 3.0)}, 2: {("area2", 6.0)}, 3: {("area3", 9.0)}}


def _publish(spark, run, db, tmp_path, **kw):
    publish_to_catalog(_spec(run), _shop(spark, run), db, f"{tmp_path}/{db}", buckets=2, run_id=f"r{run}", **kw)


def test_no_query_meets_two_runs(spark, tmp_path, monkeypatch):
    """After every single statement of a switch, SQL on the views and the library see one run."""
    db, done, steps = "switch_mart", catalog._execute, []

    def by_views():
        return {tuple(r) for r in spark.sql(f"SELECT area, revenue FROM {db}.orders_by JOIN {db}.dim_customer USING (customer_id)").collect()}

    def by_library():
        return {tuple(r) for r in rollup_published(spark, _spec(1), db, "orders_by", ["area"]).select("area", F.col("revenue") / 3).collect()}

    def watched(session, statement):
        done(session, statement)
        if current_run(spark, _spec(1), db) is not None and spark.catalog.tableExists(f"{db}.dim_customer") and spark.catalog.tableExists(f"{db}.orders_by"):
            steps.append((by_views(), by_library()))

    monkeypatch.setattr(catalog, "_execute", watched)
    for run in (1, 2, 3):
        steps.clear()
        _publish(spark, run, db, tmp_path)
        seen = [s[0] for s in steps]
        assert all(views == library for views, library in steps)
        if run > 1:
            names = 2 if run == 2 else 3
            assert seen == [SEEN[run - 1]] * names + [SEEN[run]] * (names + 1)
    assert by_views() == SEEN[3] and spark.table(f"{db}.all_orders").count() == 9
    assert {r.area for r in rollup_published(spark, _spec(1), db, "orders_by", ["area"], run_id="r1").collect()} == {"area1"}
    plan = spark.table(f"{db}.orders_by")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "orders_by__r3" in plan


def test_a_switch_that_breaks_off_stands_on_one_run(spark, tmp_path, monkeypatch):
    """Broken off before and after the pointer moved; the next switch starts from there."""
    db, done = "broken_mart", catalog._execute
    both = lambda: {tuple(r) for r in spark.sql(f"SELECT area, revenue FROM {db}.orders_by JOIN {db}.dim_customer USING (customer_id)").collect()}
    _publish(spark, 1, db, tmp_path)
    for run, steps, seen in ((2, 1, 1), (3, 4, 3)):
        left = [steps]

        def breaks(session, statement):
            if not left[0]:
                raise ConnectionError("lost")
            left[0] -= 1
            done(session, statement)

        monkeypatch.setattr(catalog, "_execute", breaks)
        with pytest.raises(ConnectionError):
            _publish(spark, run, db, tmp_path)
        assert current_run(spark, _spec(1), db) == f"r{seen}" and both() == SEEN[seen]
    plan = spark.table(f"{db}.dim_customer")._jdf.queryExecution().optimizedPlan().toString()
    assert "dim_customer__r1" not in plan  # of a view of two runs only the current one is read
    monkeypatch.setattr(catalog, "_execute", done)
    publish_to_catalog(_spec(2), _shop(spark, 2), db, f"{tmp_path}/{db}", buckets=2, run_id="again")
    assert both() == SEEN[2]


def test_a_failed_check_moves_nothing(spark, tmp_path):
    db = "failed_mart"
    _publish(spark, 1, db, tmp_path)
    bad = _shop(spark, 2)
    bad["customers"] = bad["customers"].union(bad["customers"])
    with pytest.raises(Exception, match="failed"):
        publish_to_catalog(_spec(2), bad, db, f"{tmp_path}/{db}", buckets=2, run_id="r2")
    assert current_run(spark, _spec(1), db) == "r1" and {r.area for r in spark.table(f"{db}.dim_customer").collect()} == {"area1"}


def test_an_intent_reads_one_run(spark, tmp_path):
    db = "intent_mart"
    shops = {run: _shop(spark, run) for run in (1, 2)}
    for run, shop in shops.items():
        shop["orders"] = shop["orders"].withColumn("day", F.to_date(F.lit("2024-03-01")))
        spec = _spec(run)
        spec = replace(spec, facts=(replace(spec.facts[0], time_column="day", time_grain="monthly"),))
        publish_to_catalog(spec, shop, db, f"{tmp_path}/{db}", buckets=2, run_id=f"r{run}")
    got = answer_from_mart(spark, Intent(("revenue",), ("area",), time_granularity="yearly"), spec, db, shops[2])
    assert [(r.area, r.revenue) for r in got.collect()] == [("area2", 18.0)]
    assert "orders_by__r2" in got._jdf.queryExecution().toString()


# -- salts of hot keys ----------------------------------------------------------

def test_salts_follow_from_the_row(spark):
    """The same rows in any order and any partitioning get the same salts; maps take no part."""
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.create_map(F.lit("a"), "id").alias("m"), F.array("id").alias("l"))
    salts = lambda d: sorted(map(tuple, d.select("id", _row_hash(d, None)).collect()))
    assert salts(df.repartition(7, "k")) == salts(df.orderBy(F.desc("id")).coalesce(1))
    assert len({x for _, x in salts(df)}) == 500


def test_salts_read_only_what_a_fact_reads(spark):
    df = spark.createDataFrame([], "k int, price double, tax double, note string, day date, status string")
    fact = Fact("f", ("t",), (Metric("m", "sum", expression="SUM(Price * (1 - tax))"), Metric("n", "count_distinct", "status")), ("k",), time_column="day", time_grain="daily")
    assert read_columns(fact, df) == ["k", "price", "tax", "day", "status"]
