"""Hand-checked fixtures (FIXTURES.md 1, 2, 3, 5, 6, 9): value tests."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from starmart.errors import CheckFailedError
from starmart.operators import checks, profile
from starmart.operators.dims import build_dimension
from starmart.operators.facts import build_fact
from starmart.operators.star import star_rollup
from starmart.session import scratch_path
from starmart.sinks.publish import current_mart, publish_mart
from starmart.spec import Dimension, Fact, Join, MartSpec, Metric

D = dt.date

DIM_CUSTOMER = Dimension("dim_customer", "customers", "customer_id", ("name", "region"))
REVENUE = Metric("total_revenue", "sum", "total_amount")
COUNT = Metric("order_count", "count", "order_id")


def _fact(**kw):
    base = dict(name="fact_orders", source_tables=("orders",), metrics=(REVENUE, COUNT),
                dimension_keys=("customer_id",), time_column="order_date")
    base.update(kw)
    return Fact(**base)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, v) for v in t))


# -- fixture 1 ------------------------------------------------------------------

def test_fixture1_profile(spark, fixture1):
    counts = dict((r.table_name, r.row_count) for r in profile.row_counts(fixture1, ["orders", "customers"]).collect())
    assert counts == {"orders": 3, "customers": 2}
    samples = profile.sample_values(fixture1["customers"], ["region"]).collect()
    assert {r.sample_value for r in samples} == {"Coast", "Hills"}
    keys = profile.candidate_keys(fixture1, [("orders", ["order_id"]), ("customers", ["customer_id"]),
                                             ("orders", ["customer_id"])]).collect()
    assert {(r.table_name, r.key_columns): r.is_key for r in keys} == {
        ("orders", "order_id"): True, ("customers", "customer_id"): True, ("orders", "customer_id"): False}
    cat = profile.catalog_columns(fixture1).collect()
    assert [(r.table_name, r.ordinal, r.column_name, r.data_type) for r in cat][:3] == [
        ("customers", 1, "customer_id", "int"), ("customers", 2, "name", "string"),
        ("customers", 3, "region", "string")]
    prof = {r.column_name: r for r in profile.profile_columns(fixture1["orders"]).collect()}
    assert prof["customer_id"].distinct_count == 2 and prof["order_id"].null_count == 0
    approx = {r.column_name: r.distinct_count
              for r in profile.profile_columns(fixture1["orders"], exact=False).collect()}
    assert approx["customer_id"] == 2


def test_fixture1_shortlist_keeps_declared_keys(fixture1):
    short = profile.shortlist_keys(fixture1["orders"])
    assert ("order_id",) in short and ("customer_id",) not in short


def test_fixture1_facts(spark, fixture1):
    spec = MartSpec("sales", (_fact(),), (DIM_CUSTOMER,))
    assert _rows(build_fact(_fact(), fixture1, spec)) == [(71, 59.5, 2), (72, 63.25, 1)]
    by_region = star_rollup(_fact(), fixture1, spec, ["region"], metrics=["total_revenue"])
    assert _rows(by_region) == [("Coast", 59.5), ("Hills", 63.25)]
    monthly = build_fact(_fact(dimension_keys=(), time_grain="monthly"), fixture1)
    assert _rows(monthly) == [(D(2024, 1, 1), 122.75, 3)]
    weekly = build_fact(_fact(dimension_keys=(), time_grain="weekly"), fixture1)
    assert _rows(weekly) == [(D(2024, 1, 1), 122.75, 3)]


def test_fixture1_checks(spark, fixture1):
    dom = checks.domains_of(fixture1["customers"], ["name", "region"])
    assert dom == {"name": ["Ines", "Teo"], "region": ["Coast", "Hills"]}
    rel = checks.relationship_violations(fixture1["orders"], "customer_id", fixture1["customers"], "customer_id")
    assert rel.first().n_violations == 0


# -- fixture 2: single-table mart, dimension from the orders table ---------------

def _fixture2(spark, extra=()):
    rows = [(1, 71, 310.0), (2, 72, 295.0), *extra]
    orders = spark.createDataFrame(rows, "order_id int, customer_id int, amount double")
    return {"orders": orders}


def _spec2(dedupe=False):
    fact = Fact("fact_orders", ("orders",), (Metric("total_revenue", "sum", "amount"),), ("customer_id",))
    dim = Dimension("dim_customer", "orders", "customer_id", (), dedupe=dedupe)
    return MartSpec("m", (fact,), (dim,))


def _failed(report):
    return {(r.table_name, r.column_name, r.check_name): r.n_violations
            for r in report.collect() if not r.passed}


def test_fixture2_passes(spark):
    t = _fixture2(spark)
    spec = _spec2()
    assert _rows(build_fact(spec.facts[0], t, spec)) == [(71, 310.0), (72, 295.0)]
    assert _rows(build_dimension(spec.dimensions[0], t)) == [(71,), (72,)]
    assert _failed(checks.check_report(spec, t)) == {}


def test_fixture2_duplicate_dimension_key(spark):
    t = _fixture2(spark, [(3, 71, 1.0)])
    assert _failed(checks.check_report(_spec2(), t)) == {("dim_customer", "customer_id", "unique"): 1}
    assert _failed(checks.check_report(_spec2(dedupe=True), t)) == {}


def test_publish_refuses_failing_checks(spark):
    root = scratch_path(spark, "fixture2")
    good = publish_mart(_spec2(), _fixture2(spark), root)
    assert current_mart(spark, root).run_id == good.run_id
    with pytest.raises(CheckFailedError) as e:
        publish_mart(_spec2(), _fixture2(spark, [(3, 71, 1.0)]), root, run_id="bad")
    assert "unique" in str(e.value)
    saved = spark.read.json(f"{root}/bad/_checks")
    assert saved.where("not passed").count() == 1
    # the earlier run stays published
    assert current_mart(spark, root).run_id == good.run_id
    assert _rows(current_mart(spark, root).read(spark)["fact_orders"]) == [(71, 310.0), (72, 295.0)]


# -- fixture 3: type conformance ---------------------------------------------------

def test_fixture3_types(spark, fixture1):
    fact = _fact(metrics=(REVENUE, COUNT, Metric("first", "min", "order_date"), Metric("top", "max", "total_amount"),
                          Metric("avg_amt", "avg", "total_amount"), Metric("n_cust", "count_distinct", "customer_id"),
                          Metric("expr_only", "min", None, expression="MIN(order_id)")))
    spec = MartSpec("sales", (fact,), (DIM_CUSTOMER,))
    df = build_fact(fact, fixture1, spec)
    types = {f.name: f.dataType for f in df.schema.fields}
    assert types["customer_id"] == T.IntegerType()
    assert types["total_revenue"] == T.DoubleType()
    assert types["order_count"] == T.LongType()
    assert types["first"] == T.DateType()
    assert types["top"] == T.DoubleType()
    assert types["avg_amt"] == T.DoubleType()
    assert types["n_cust"] == T.LongType()
    assert types["expr_only"] == T.IntegerType()  # expression-only min/max stays uncast
    assert df.columns[:1] == ["customer_id"]
    dim = build_dimension(DIM_CUSTOMER, fixture1)
    assert dim.columns == ["customer_id", "name", "region"]


def test_fact_key_cast_to_dimension_key_type(spark):
    orders = spark.createDataFrame([(1, 7, 1.0)], "order_id int, cust int, amount double")
    customers = spark.createDataFrame([(7, "x")], "cust_key bigint, name string")
    t = {"orders": orders, "customers": customers}
    fact = Fact("f", ("orders",), (Metric("n", "count"),), ("cust",), key_map={"cust": "d"})
    spec = MartSpec("m", (fact,), (Dimension("d", "customers", "cust_key", ("name",)),))
    assert build_fact(fact, t, spec).schema["cust"].dataType == T.LongType()
    assert _rows(star_rollup(fact, t, spec, ["name"])) == [("x", 1)]


# -- fixture 5: multi-source fact -------------------------------------------------

def test_fixture5_multi_source_and_fanout(spark):
    primary = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 99)], "id int, ref int")
    secondary = spark.createDataFrame([(10, "a"), (20, "b")], "ref_id int, dim_id string")
    fact = Fact("f", ("primary", "secondary"), (Metric("n", "count"),), ("dim_id",),
                joins=(Join("secondary", "ref", "ref_id"),))
    t = {"primary": primary, "secondary": secondary}
    assert _rows(build_fact(fact, t)) == [(None, 1), ("a", 2), ("b", 1)]
    dup = spark.createDataFrame([(10, "a"), (10, "c"), (20, "b")], "ref_id int, dim_id string")
    with pytest.raises(Exception) as e:
        build_fact(fact, {"primary": primary, "secondary": dup}).collect()
    assert "not unique" in str(e.value)


# -- fixture 6: accepted values rules --------------------------------------------

def test_fixture6_accepted_values(spark):
    eleven = [f"s{i}" for i in range(11)]
    rows = [(i, eleven[i], "A" if i % 2 else "B", i, "x") for i in range(11)]
    df = spark.createDataFrame(rows, "k int, many string, status string, num int, one string")
    dom = checks.domains_of(df)
    assert dom == {"status": ["A", "B"], "one": ["x"]}
    nulls = spark.createDataFrame([(1, None)], "k int, status string")
    assert checks.domains_of(nulls) == {}
    bad = checks.accepted_values_counts(df, {"status": ["A"]}, "t").first()
    assert (bad.check_name, bad.n_violations, bad.passed) == ("accepted_values", 6, False)


def test_check_report_key_never_gets_accepted_values(spark):
    dims = spark.createDataFrame([("a", "x"), ("b", "y")], "code string, label string")
    spec = MartSpec("m", (), (Dimension("d", "dims", "code", ("label",)),))
    rep = checks.check_report(spec, {"dims": dims}).collect()
    got = {(r.column_name, r.check_name) for r in rep}
    assert got == {("code", "not_null"), ("code", "unique"), ("label", "accepted_values")}


# -- fixture 9: nulls ---------------------------------------------------------------

def test_fixture9_nulls(spark):
    orders = spark.createDataFrame([(1, 71, 10.0), (2, 71, None), (3, 72, None), (4, None, 5.0), (5, 999, 1.0)],
                                   "order_id int, customer_id int, amount double")
    parents = spark.createDataFrame([(71,), (72,)], "customer_id int")
    t = {"orders": orders, "customers": parents}
    fact = Fact("f", ("orders",), (Metric("s", "sum", "amount"), Metric("n", "count", "amount"),
                                   Metric("rows", "count"), Metric("a", "avg", "amount")), ("customer_id",))
    got = {r.customer_id: (r.s, r.n, r.rows, r.a) for r in build_fact(fact, t).collect()}
    assert got == {71: (10.0, 1, 2, 10.0), 72: (None, 0, 1, None), None: (5.0, 1, 1, 5.0), 999: (1.0, 1, 1, 1.0)}
    spec = MartSpec("m", (fact,), (Dimension("d", "customers", "customer_id"),))
    failed = _failed(checks.check_report(spec, t))
    assert failed == {("f", "customer_id", "not_null"): 1, ("f", "s", "not_null"): 1, ("f", "a", "not_null"): 1,
                      ("f", "customer_id", "relationships"): 1}
    orphans = checks.orphan_rows(orders, "customer_id", parents, "customer_id").collect()
    assert [r.order_id for r in orphans] == [5]


def test_relationship_strategies_agree(spark):
    """Broadcast anti join and pre-aggregated left join give the same counts,
    also when one orphan key holds a third of the child rows."""
    rows = [(i, 999 if i % 3 == 0 else (i % 5) + 1) for i in range(300)] + [(1000, None)]
    child = spark.createDataFrame(rows, "id int, fk int")
    parent = spark.createDataFrame([(k,) for k in range(1, 5)], "pk int")
    small = checks.relationship_violations(child, "fk", parent, "pk", broadcast_rows=10**6).first()
    large = checks.relationship_violations(child, "fk", parent, "pk", broadcast_rows=0).first()
    expect = sum(1 for _, fk in rows if fk is not None and fk not in (1, 2, 3, 4))
    assert small.n_violations == large.n_violations == expect
    keys_small = checks.relationship_violations(child, "fk", parent, "pk", distinct_keys=True).first()
    assert keys_small.n_violations == 2  # 999 and 5
    a = sorted(r.id for r in checks.orphan_rows(child, "fk", parent, "pk", broadcast_rows=10**6).collect())
    b = sorted(r.id for r in checks.orphan_rows(child, "fk", parent, "pk", broadcast_rows=0).collect())
    assert a == b and len(a) == expect


def test_describe_sources_fixture1(spark, fixture1):
    rows = {(r.table_name, r.column_name): r for r in profile.describe_sources(
        fixture1, include_sample_values=True, detect_keys=True).collect()}
    assert rows[("customers", "region")].sample_values == ["Coast", "Hills"]
    assert rows[("customers", "region")].row_count == 2
    assert rows[("orders", "order_id")].is_primary_key
    assert rows[("customers", "customer_id")].is_primary_key
    assert not rows[("orders", "customer_id")].is_primary_key
    assert not rows[("orders", "total_amount")].is_primary_key  # floating point is never a key
    off = profile.describe_sources(fixture1, include_row_counts=False).collect()
    assert all(r.row_count is None and r.is_primary_key is False for r in off)
    assert [(r.table_name, r.ordinal) for r in off] == sorted((r.table_name, r.ordinal) for r in off)


def test_fixture3_target_schemas(spark):
    """Target types and constraints (FIXTURES.md 3), from analysis only."""
    import datetime as _dt
    from starmart.plans.schema import describe, target_schemas
    customers = spark.createDataFrame([(71, "Ines", "Coast")], T.StructType([
        T.StructField("customer_id", T.IntegerType(), False), T.StructField("name", T.StringType(), False),
        T.StructField("region", T.StringType(), True)]))
    orders = spark.createDataFrame([(1, 71, _dt.date(2024, 1, 1), 41.5)],
                                   "order_id int, customer_id int, order_date date, total_amount double")
    fact = Fact("fact_orders", ("orders",), (REVENUE, COUNT, Metric("first", "min", "order_date"),
                                             Metric("other", "min", None, expression="MIN(order_id) * 2")),
                ("customer_id",))
    spec = MartSpec("sales", (fact,), (DIM_CUSTOMER,))
    s = target_schemas(spec, {"orders": orders, "customers": customers})
    assert list(s) == ["dim_customer", "fact_orders"]  # dimensions first
    dim = {f.name: f for f in s["dim_customer"].fields}
    assert dim["customer_id"].dataType == T.IntegerType() and dim["customer_id"].metadata["primary_key"]
    assert dim["name"].metadata.get("not_null") and not dim["region"].metadata.get("not_null")
    f = {x.name: x for x in s["fact_orders"].fields}
    assert [x.name for x in s["fact_orders"].fields][0] == "customer_id"
    assert f["customer_id"].metadata["references"] == ["dim_customer.customer_id"]
    assert (f["total_revenue"].dataType, f["order_count"].dataType, f["first"].dataType) == (
        T.DoubleType(), T.LongType(), T.DateType())
    assert f["other"].dataType == T.IntegerType()  # expression-only min stays as computed
    text = describe(s)
    assert "customer_id int PRIMARY KEY NOT NULL" in text and "REFERENCES dim_customer.customer_id" in text


def test_duplicate_key_rows_show_conflicts(spark):
    t = _fixture2(spark, [(3, 71, 1.0)])
    dim = Dimension("d", "orders", "customer_id", ("amount",), dedupe=True)
    rows = checks.duplicate_key_rows(build_dimension(dim, t), "customer_id").collect()
    assert sorted((r.customer_id, r.amount) for r in rows) == [(71, 1.0), (71, 310.0)]
