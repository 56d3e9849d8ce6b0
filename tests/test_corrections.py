"""Signed deltas of a fact, and checks of a refresh, against a rebuild."""

import datetime as dt
import decimal
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.errors import CheckFailedError, SpecError
from starmart.operators.checks import check_report, failures, refresh_report
from starmart.operators.facts import build_fact
from starmart.sinks.publish import write_table
from starmart.spec import Dimension, Fact, MartSpec, Metric
from starmart.streaming.corrections import correct_fact, write_correctable_fact
from starmart.streaming.incremental import refresh_fact, refresh_partitioned_fact, write_fact

SCHEMA = "id int, k string, day date, i int, d decimal(9,2), x double"
METRICS = (Metric("n", "count"), Metric("ni", "count", "i"), Metric("si", "sum", "i"), Metric("sd", "sum", "d"), Metric("sx", "sum", "x"), Metric("lo", "min", "i"), Metric("hi", "max", "d"),
           Metric("ai", "avg", "i"), Metric("ax", "avg", "x"), Metric("di", "count_distinct", "i"), Metric("ratio", "sum", expression="SUM(i) / COUNT(*)"),
           Metric("add", "sum", expression="SUM(CAST(d AS DECIMAL(18,2)))", additive=True))
FACT = Fact("f", ("t",), METRICS, ("k",), time_column="day", time_grain="monthly")


def _rows(rng, n, first):
    none = lambda v, p: None if rng.random() < p else v
    return [(first + j, none("abc"[rng.integers(3)], 0.1), none(dt.date(2024, int(rng.integers(1, 4)), 3), 0.1), none(int(rng.integers(-3, 4)), 0.3),
             none(decimal.Decimal(int(rng.integers(-500, 500))) / 100, 0.3), none(float(rng.integers(-8, 9)) / 8, 0.2)) for j in range(n)]


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("fact", [FACT, replace(FACT, dimension_keys=(), time_grain=None)])
@pytest.mark.parametrize("bound", [None, 0])
def test_equal_to_a_rebuild(spark, tmp_path, fact, bound):
    rng = np.random.default_rng(3)
    first = _rows(rng, 120, 0) + [(900, "only", dt.date(2024, 5, 5), 1, decimal.Decimal("1.00"), 0.5), (901, "gone", None, None, None, None)]
    frame = lambda rs: {"t": spark.createDataFrame(rs, SCHEMA)}
    write_correctable_fact(fact, frame(first), f"{tmp_path}/0")
    stand = first
    for step in (1, 2):
        out = [r for r in stand if rng.random() < 0.5 or r[1] == "gone"]
        new = _rows(rng, 30, 1000 * step)
        stand = [r for r in stand if r not in out] + new
        got = correct_fact(fact, f"{tmp_path}/{step - 1}", frame(new), frame(out), frame(stand), f"{tmp_path}/{step}", broadcast_rows=bound)
        want = build_fact(fact, frame(stand))
        assert rows(got, want.columns) == rows(want, want.columns)


def test_only_unclear_groups_are_read_again(spark, tmp_path):
    """A deletion that reaches no extreme needs nothing of the source after it."""
    fact = replace(FACT, metrics=(METRICS[0], METRICS[3], METRICS[5], METRICS[7]), time_grain=None)
    base = [(j, "a", None, j % 5, decimal.Decimal(j), 0.0) for j in range(20)]
    frame = lambda rs: {"t": spark.createDataFrame(rs, SCHEMA)}
    write_correctable_fact(fact, frame(base), f"{tmp_path}/0")
    out = [r for r in base if r[3] == 3][:2]
    wrong_source = frame([])  # would show if it were read
    got = correct_fact(fact, f"{tmp_path}/0", frame([]), frame(out), wrong_source, f"{tmp_path}/1")
    want = build_fact(fact, frame([r for r in base if r not in out]))
    assert rows(got, want.columns) == rows(want, want.columns)
    with pytest.raises(Exception, match="more rows deleted"):
        correct_fact(fact, f"{tmp_path}/0", frame([]), frame([(0, "zz", None, 1, None, None)]), frame(base), f"{tmp_path}/2")
    write_table(build_fact(fact, frame(base)), f"{tmp_path}/plain")
    with pytest.raises(SpecError, match="write_correctable_fact"):
        correct_fact(fact, f"{tmp_path}/plain", frame([]), frame(out), frame(base), f"{tmp_path}/3")


# -- checks on refresh ----------------------------------------------------------

ORDERS = "customer int, price int, day date"
MART = MartSpec("m", (Fact("fact_o", ("o",), (Metric("total", "sum", "price"), Metric("n", "count")), ("customer",), key_map={"customer": "dim_c"}),), (Dimension("dim_c", "c", "id", ("name",)),))


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(i, f"c{i}") for i in range(5)], "id int, name string")


@pytest.mark.parametrize("new, bad", [
    ([(1, 5, None), (2, 1, None)], set()),
    ([(9, 5, None), (9, 6, None), (8, 1, None)], {("customer", "relationships", 2)}),
    ([(None, 5, None)], {("customer", "not_null", 1)}),
    ([(1, None, None)], set()),                            # the group has a total already
    ([(4, None, None)], {("total", "not_null", 1)}),       # this one has not
])
def test_the_touched_groups_tell_the_verdict(spark, customers, tmp_path, new, bad):
    fact, frame = MART.facts[0], lambda rs: {"o": spark.createDataFrame(rs, ORDERS), "c": customers}
    base = [(0, 1, None), (1, 2, None), (1, 3, None)]
    write_fact(fact, frame(base), f"{tmp_path}/0", MART)
    current, delta = spark.read.parquet(f"{tmp_path}/0"), build_fact(fact, frame(new), MART)
    found = refresh_report(fact, MART, delta, current, {"dim_c": customers})
    full = check_report(MART, frame(base + new)).where("table_name = 'fact_o'")
    assert rows(found, found.columns) == rows(full, found.columns)
    assert {(f["column_name"], f["check_name"], f["n_violations"]) for f in failures(found)} == bad
    if bad:
        with pytest.raises(CheckFailedError, match="current version stays"):
            refresh_fact(fact, f"{tmp_path}/0", frame(new), f"{tmp_path}/1", MART, dims={"dim_c": customers})
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(f"{tmp_path}/1")
    else:
        got = refresh_fact(fact, f"{tmp_path}/0", frame(new), f"{tmp_path}/1", MART, dims={"dim_c": customers})
        want = build_fact(fact, frame(base + new), MART)
        assert rows(got, want.columns) == rows(want, want.columns)


def test_a_partitioned_refresh_is_refused_too(spark, customers, tmp_path):
    fact = replace(MART.facts[0], time_column="day", time_grain="daily")
    spec, day = replace(MART, facts=(fact,)), dt.date(2024, 1, 1)
    frame = lambda rs: {"o": spark.createDataFrame(rs, ORDERS), "c": customers}
    write_table(build_fact(fact, frame([(0, 1, day)]), spec), f"{tmp_path}/f", partition_by=["period"])
    with pytest.raises(CheckFailedError):
        refresh_partitioned_fact(fact, f"{tmp_path}/f", frame([(7, 1, day)]), f"{tmp_path}/s0", spec, dims={"dim_c": customers})
    assert spark.read.parquet(f"{tmp_path}/f").count() == 1
    assert refresh_partitioned_fact(fact, f"{tmp_path}/f", frame([(3, 1, day)]), f"{tmp_path}/s1", spec, dims={"dim_c": customers}) == [day]
    assert spark.read.parquet(f"{tmp_path}/f").count() == 2
