"""Metrics at the grain of their own table, the published path's guards, and averages on a stream."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from starmart.errors import IntentError, NonAdditiveMetricError, SpecError
from starmart.operators.facts import build_fact, build_fact_states
from starmart.operators.grains import home_of
from starmart.operators.star import answer, rollup_states, star_rollup
from starmart.sinks.catalog import publish_to_catalog, rollup_published
from starmart.sinks.publish import write_table
from starmart.spec import Dimension, Fact, Intent, Join, MartSpec, Metric
from starmart.streaming.incremental import read_current, refresh_fact, start_fact_stream

D = dt.date


@pytest.fixture(scope="module")
def shop(spark):
    """Three orders: one with three lines, one without, and a line of no order; order_id is named alike on both sides."""
    lines = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (1, 7, 4), (2, 8, 5), (9, 7, 1), (None, 7, 1)], "order_id int, product_id int, qty int")
    orders = spark.createDataFrame([(1, 10, D(2024, 1, 5), 100.0, "F"), (2, 20, D(2024, 2, 5), 50.0, "O"), (3, 10, D(2024, 2, 9), 25.0, "F")],
                                   "order_id int, customer_id int, day date, price double, status string")
    customers = spark.createDataFrame([(10, "north"), (20, "south")], "customer_id int, area string")
    return {"lines": lines, "orders": orders, "customers": customers}


FACT = Fact("sales", ("lines", "orders"), (Metric("qty", "sum", "qty"), Metric("lines", "count"), Metric("revenue", "sum", "price"), Metric("orders", "count", "order_id", table="orders")),
            ("customer_id",), joins=(Join("orders", "order_id", "order_id"),), key_map={"customer_id": "dim_customer"})
MART = MartSpec("shop", (FACT,), (Dimension("dim_customer", "customers", "customer_id", ("area",)),))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bound", [None, 0])
def test_an_order_counts_once(spark, shop, bound):
    got = rows(build_fact(FACT, shop, MART, broadcast_rows=bound))
    # order 3 has no line; two lines have no order
    assert got == rows(spark.createDataFrame([(10, 7.0, 3, 125.0, 2), (20, 5.0, 1, 50.0, 1), (None, 2.0, 2, None, 0)], "a int, b double, c long, d double, e long"))


def test_states_and_star(spark, shop):
    states = build_fact_states(FACT, shop)
    assert rows(rollup_states(states, FACT, [])) == [(14.0, 6, 175.0, 3)]
    assert rows(star_rollup(FACT, shop, MART, ["area"])) == rows(spark.createDataFrame(
        [("north", 7.0, 3, 125.0, 2), ("south", 5.0, 1, 50.0, 1), (None, 2.0, 2, None, 0)], "a string, b double, c long, d double, e long"))
    assert rows(star_rollup(FACT, shop, MART, ["area"], filters={"area": "north"}, metrics=["revenue"])) == [("north", 125.0)]
    assert rows(star_rollup(FACT, shop, MART, ["status"], metrics=["revenue", "qty"])) == rows(spark.createDataFrame(
        [("F", 125.0, 7.0), ("O", 50.0, 5.0), (None, None, 2.0)], "a string, b double, c double"))


def test_join_key_stands_for_the_home_side(shop):
    orders = shop["orders"].withColumnRenamed("order_id", "id")
    fact = replace(FACT, dimension_keys=("order_id",), key_map={}, joins=(Join("orders", "order_id", "id"),), metrics=FACT.metrics[:3])
    got = {r["order_id"]: (r["qty"], r["revenue"]) for r in build_fact(fact, {**shop, "orders": orders}).collect()}
    assert got == {1: (7.0, 100.0), 2: (5.0, 50.0), 3: (None, 25.0), 9: (1.0, None), None: (1.0, None)}


@pytest.mark.parametrize("change, words", [
    (dict(dimension_keys=("product_id",), key_map={}), "do not reach the key 'product_id'"),
    (dict(filters={"product_id": "7"}), "do not reach the filter column 'product_id'"),
])
def test_a_metric_that_cannot_be_placed_is_refused(shop, change, words):
    with pytest.raises(SpecError, match=words):
        build_fact(replace(FACT, **change), shop)
    with pytest.raises(SpecError, match="reads? \\("):
        build_fact(replace(FACT, metrics=(Metric("x", "sum", "price", table="customers"),)), shop)


def test_star_by_the_lines_own_key_is_refused(shop):
    with pytest.raises(SpecError, match="product_id"):
        star_rollup(FACT, shop, MART, ["product_id"], metrics=["qty", "revenue"])
    assert star_rollup(FACT, shop, MART, ["product_id"], metrics=["qty"]).count() == 2


def test_homes(shop):
    both = Metric("value", "sum", expression="SUM(qty * price)")
    assert [home_of(m, FACT, shop) for m in (*FACT.metrics, both)] == ["lines", "lines", "orders", "orders", "lines"]


def test_refresh_of_a_secondary_metric_is_refused(spark, shop, tmp_path):
    write_table(build_fact(FACT, shop), f"{tmp_path}/v=0")
    with pytest.raises(SpecError, match="joined tables"):
        refresh_fact(FACT, f"{tmp_path}/v=0", shop, f"{tmp_path}/v=1")


def test_intent_over_two_facts(shop):
    orders = Fact("orders", ("orders",), (Metric("revenue", "sum", "price"),), ("customer_id",), key_map={"customer_id": "dim_customer"}, time_column="day")
    lines = replace(FACT, metrics=FACT.metrics[:1], time_column="day")
    spec = replace(MART, facts=(orders, lines))
    got = rows(answer(Intent(("qty", "revenue"), ("area",), time_granularity="monthly"), spec, shop))
    assert got == sorted([(D(2024, 1, 1), "north", 7.0, 100.0), (D(2024, 2, 1), "south", 5.0, 50.0), (D(2024, 2, 1), "north", None, 25.0), (None, None, 2.0, None)], key=str)
    with pytest.raises(IntentError, match="exactly one fact"):
        answer(Intent(("qty", "margin"), ("area",)), spec, shop)


# -- the published path -------------------------------------------------------

def _publish(spark, tmp_path, spec, tables, name):
    publish_to_catalog(spec, tables, name, f"{tmp_path}/{name}", buckets=4)


def test_weeks_are_not_summed_to_months(spark, shop, tmp_path):
    weekly = Fact("weekly", ("orders",), (Metric("revenue", "sum", "price"),), ("customer_id",), key_map={"customer_id": "dim_customer"}, time_column="day", time_grain="weekly")
    spec = replace(MART, facts=(weekly,))
    _publish(spark, tmp_path, spec, shop, "weekly_mart")
    for grain in ("monthly", "daily", "yearly"):
        with pytest.raises(NonAdditiveMetricError, match="weekly"):
            rollup_published(spark, spec, "weekly_mart", "weekly", ["area"], grain=grain)
    assert rollup_published(spark, spec, "weekly_mart", "weekly", ["area"], grain="weekly").count() == 3


def test_ambiguous_attributes_must_be_qualified(spark, tmp_path):
    """A parcel goes from one city to another: both keys lead to dimensions with a name."""
    parcels = spark.createDataFrame([(1, 2, 10.0), (2, 1, 5.0), (1, 1, 1.0)], "src int, dst int, kg double")
    cities = spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "id int, name string")
    fact = Fact("parcels", ("parcels",), (Metric("kg", "sum", "kg"),), ("src", "dst"), key_map={"src": "dim_city", "dst": "dim_city"})
    spec, tables = MartSpec("post", (fact,), (Dimension("dim_city", "cities", "id", ("name",)),)), {"parcels": parcels, "cities": cities}
    _publish(spark, tmp_path, spec, tables, "post_mart")
    ask = [lambda by, **kw: star_rollup(fact, tables, spec, by, **kw), lambda by, **kw: star_rollup(fact, tables, spec, by, broadcast_rows=0, **kw),
           lambda by, **kw: rollup_published(spark, spec, "post_mart", "parcels", by, **kw)]
    for answers in ask:
        for by in (["name"], ["dim_city.name"]):
            with pytest.raises(IntentError, match="more than one way"):
                answers(by)
        one = answers(["src.name"])
        assert one.columns == ["name", "kg"] and rows(one) == [("Oslo", 5.0), ("Rome", 11.0)]
        two = answers(["src.name", "dst.name"])
        assert two.columns == ["src_name", "dst_name", "kg"]
        assert rows(two) == [("Oslo", "Rome", 5.0), ("Rome", "Oslo", 10.0), ("Rome", "Rome", 1.0)]
        assert rows(answers(["dst.name"], filters={"src.name": "Rome"})) == [("Oslo", 10.0), ("Rome", 1.0)]


def test_proven_uniqueness_is_not_proven_again(spark, shop, tmp_path):
    fact = Fact("orders_by", ("orders",), (Metric("revenue", "sum", "price"),), ("customer_id",), key_map={"customer_id": "dim_customer"})
    spec = replace(MART, facts=(fact,))
    _publish(spark, tmp_path, spec, shop, "proven_mart")
    plan = rollup_published(spark, spec, "proven_mart", "orders_by", ["area"])._jdf.queryExecution().toString()
    assert "raise_error" not in plan
    publish_to_catalog(spec, shop, "unproven_mart", f"{tmp_path}/unproven_mart", buckets=4, check=False)
    plan = rollup_published(spark, spec, "unproven_mart", "orders_by", ["area"])._jdf.queryExecution().toString()
    assert "raise_error" in plan


def test_an_average_on_a_stream(spark, tmp_path):
    fact = Fact("avgs", ("ticks",), (Metric("mean", "avg", "v"), Metric("n", "count")), ("k",))
    src, schema = f"{tmp_path}/src", "k string, v int"
    seen = []
    for batch in ([("a", 1), ("a", 2), ("b", None)], [("a", 6), ("b", 4)], [("c", 1)]):
        seen += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        start_fact_stream(spark, fact, "ticks", src, spark.createDataFrame([], schema).schema, f"{tmp_path}/mart", f"{tmp_path}/cp").awaitTermination()
        want = build_fact(fact, {"ticks": spark.createDataFrame(seen, schema)})
        assert rows(read_current(spark, f"{tmp_path}/mart").select("k", "mean", "n")) == rows(want)


def test_the_smallest_fact_that_can_answer(spark, shop, tmp_path):
    """One intent from three facts and from the sources, with equal results; the plan names the fact."""
    from starmart.sinks.catalog import answer_from_mart, facts_for
    revenue, n = Metric("revenue", "sum", "price"), Metric("n", "count")
    facts = tuple(Fact(name, ("orders",), ms, keys, key_map={"customer_id": "dim_customer"} if "customer_id" in keys else {}, time_column="day", time_grain=grain, filters=filters)
                  for name, ms, keys, grain, filters in (
                      ("wide_daily", (revenue, n, Metric("customers", "count_distinct", "customer_id")), ("customer_id", "status", "order_id"), "daily", {}),
                      ("monthly", (revenue, n), ("customer_id", "status"), "monthly", {}), ("yearly", (revenue,), ("customer_id",), "yearly", {}), ("weekly", (revenue,), ("customer_id",), "weekly", {}),
                      ("finished", (revenue, n), ("customer_id",), "monthly", {"status": "F"})))
    spec = replace(MART, facts=facts)
    publish_to_catalog(spec, shop, "nav_mart", f"{tmp_path}/nav_mart", buckets=1, check=False)
    choose = lambda i: facts_for(spark, i, spec, "nav_mart")
    yearly = Intent(("revenue",), ("area",), time_granularity="yearly")
    assert choose(yearly)[0] == "yearly" and set(choose(yearly)) == {"yearly", "monthly", "wide_daily"}
    assert choose(replace(yearly, time_granularity="weekly")) == ["weekly", "wide_daily"]
    assert choose(replace(yearly, required_dimensions=("status",))) == ["monthly", "wide_daily"]
    assert choose(replace(yearly, filters={"status": "F"})) == ["finished", "monthly", "wide_daily"]
    assert choose(Intent(("customers",), ("status",), time_granularity="yearly")) == ["wide_daily"]
    assert choose(Intent(("revenue",), ("product_id",), time_granularity="yearly")) == []
    for intent in (yearly, replace(yearly, filters={"status": "F"}), replace(yearly, filters={"year_from": "2024"})):
        got = answer_from_mart(spark, intent, spec, "nav_mart", shop)
        assert choose(intent)[0] in got._jdf.queryExecution().toString()
        want = answer(intent, replace(spec, facts=facts[:1]), shop, fact_name="wide_daily")
        assert rows(got) == rows(want) and got.count()
    with pytest.raises(IntentError, match="defined differently"):
        facts_for(spark, yearly, replace(spec, facts=(*facts, replace(facts[0], name="x", metrics=(Metric("revenue", "max", "price"),)))), "nav_mart")
