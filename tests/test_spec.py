"""Preconditions on specs and intents (FIXTURES.md 7)."""

import pytest

from starmart.errors import IntentError, SpecError, UnknownTableError
from starmart.spec import Dimension, Fact, Intent, Join, MartSpec, Metric, validate_intent, validate_spec


def _spec(**over):
    dim = over.pop("dim", Dimension("dim_customer", "customers", "customer_id", ("name", "region")))
    fact = over.pop("fact", Fact("fact_orders", ("orders",), (Metric("total_revenue", "sum", "total_amount"),),
                                 ("customer_id",)))
    return MartSpec("sales", (fact,), (dim,))


def test_valid_spec(fixture1):
    validate_spec(_spec(), fixture1)


@pytest.mark.parametrize("dim, needle", [
    (Dimension("d", "nope", "customer_id"), "nope"),
    (Dimension("d", "customers", "cust"), "cust"),
    (Dimension("d", "customers", "customer_id", ("name", "zone")), "zone"),
])
def test_dimension_failures(fixture1, dim, needle):
    with pytest.raises(SpecError) as e:
        validate_spec(_spec(dim=dim), fixture1)
    assert needle in str(e.value)
    assert "Available" in str(e.value)


def test_unknown_table_is_spec_error(fixture1):
    with pytest.raises(UnknownTableError):
        validate_spec(_spec(dim=Dimension("d", "nope", "customer_id")), fixture1)


@pytest.mark.parametrize("fact, needle", [
    (Fact("f", ("orders",), (Metric("m", "sum", "amount"),), ("customer_id",)), "amount"),
    (Fact("f", ("orders",), (Metric("m", "sum", "total_amount"),), ("cust",)), "cust"),
    (Fact("f", ("orders", "customers"), (Metric("m", "sum", "total_amount"),), ("customer_id",)), "customers"),
    (Fact("f", ("orders",), (Metric("m", "count"),), ("customer_id",), filters={"status": "x"}), "status"),
    (Fact("f", ("orders",), (Metric("m", "count"),), ("customer_id",), filters={"year_from": "2023"}), "year_from"),
])
def test_fact_failures(fixture1, fact, needle):
    with pytest.raises(SpecError) as e:
        validate_spec(_spec(fact=fact), fixture1)
    assert needle in str(e.value)


def test_metric_and_fact_shape_errors():
    with pytest.raises(SpecError):
        Metric("m", "median", "x")
    with pytest.raises(SpecError):
        Metric("m", "sum")
    with pytest.raises(SpecError):
        Fact("f", ("t",), (Metric("m", "count"), Metric("m", "count")))
    with pytest.raises(SpecError):
        Fact("f", ("t",), (Metric("m", "count"),), time_grain="hourly", time_column="ts")
    with pytest.raises(SpecError):
        Join("t", ("a", "b"), ("a",))


@pytest.mark.parametrize("intent, needle", [
    (Intent((), ("region",)), "required_metrics"),
    (Intent(("revenue",), ()), "required_dimensions"),
    (Intent(("revenue",), ("region",), time_granularity="hourly"), "hourly"),
])
def test_intent_failures(intent, needle):
    with pytest.raises(IntentError) as e:
        validate_intent(intent)
    assert needle in str(e.value)


def test_json_roundtrip():
    spec = MartSpec("m", (Fact("f", ("orders",), (Metric("n", "count"),), ("customer_id",),
                               key_map={"customer_id": "d"}, time_column="order_date", time_grain="monthly",
                               joins=(Join("customers", "customer_id", "customer_id"),)),),
                    (Dimension("d", "customers", "customer_id", ("region",), dedupe=True),),
                    intent=Intent(("n",), ("region",), time_granularity="weekly"))
    again = MartSpec.from_json(spec.to_json())
    assert again == spec
    with pytest.raises(SpecError):
        MartSpec.from_dict({"mart_name": "x", "facts": [], "bogus": 1})


def test_additivity():
    assert Metric("a", "sum", "x").is_additive
    assert not Metric("a", "avg", "x").is_additive
    assert not Metric("a", "count_distinct", "x").is_additive
    assert not Metric("a", "sum", "x", expression="SUM(x)/COUNT(*)").is_additive
    assert Metric("a", "sum", "x", expression="SUM(x*2)", additive=True).is_additive


def test_bad_expression_names_fact_and_metric(spark, fixture1):
    from starmart.operators.facts import build_fact
    fact = Fact("f", ("orders",), (Metric("m", "sum", "total_amount", expression="SUM(no_such_col)"),),
                ("customer_id",))
    with pytest.raises(SpecError) as e:
        build_fact(fact, fixture1)
    assert "'f'" in str(e.value) and "'m'" in str(e.value) and "total_amount" in str(e.value)


def test_arm_column_clash_is_reported(spark):
    base = spark.createDataFrame([(1, 10, "x")], "id int, ref int, name string")
    arm = spark.createDataFrame([(10, "y")], "ref_id int, name string")
    dim = Dimension("d", "base", "id", ("name",), joins=(Join("arm", "ref", "ref_id"),))
    with pytest.raises(SpecError) as e:
        validate_spec(MartSpec("m", (), (dim,)), {"base": base, "arm": arm})
    assert "name" in str(e.value)


def test_metric_key_name_collisions():
    with pytest.raises(SpecError):
        Fact("f", ("t",), (Metric("customer_id", "count"),), ("customer_id",))
    with pytest.raises(SpecError):
        Fact("f", ("t",), (Metric("period", "count"),), (), time_column="ts", time_grain="daily")
    with pytest.raises(SpecError):
        Fact("f", ("t",), (Metric("n", "count"),), ("a", "a"))
