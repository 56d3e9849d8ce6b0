"""Refreshes without a time or without rows, averages on both plans, hot and NULL keys,
discovery of composite keys and integer measures, checks that can fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starmart.errors import IntentError, NonAdditiveMetricError
from starmart.operators import checks, discover
from starmart.operators.facts import apply_filters, build_fact
from starmart.operators.star import star_rollup
from starmart.plans.joins import fits_broadcast, skew_split_join
from starmart.session import scratch_path
from starmart.sinks.publish import write_table
from starmart.sources.tables import load_tables
from starmart.spec import Dimension, Fact, MartSpec, Metric
from starmart.streaming.incremental import _stage_and_overwrite, merge_fact, refresh_partitioned_fact

from conftest import SF_SMALL

DAY = dt.datetime(2024, 1, 1)
EVENTS = "t timestamp_ntz, kind string, v decimal(12,2), n bigint"
FACT = Fact("f", ("e",), (Metric("total", "sum", "v"), Metric("rows", "count")), ("kind",), time_column="t", time_grain="daily")


def _events(spark, rows):
    return spark.createDataFrame([(t, k, None if v is None else __import__("decimal").Decimal(v), n) for t, k, v, n in rows], EVENTS)


def _read(spark, path):
    return sorted(map(str, ((r.period, r.kind, r.total, r.rows) for r in spark.read.parquet(path).collect())))


def test_refresh_keeps_rows_without_a_period(spark):
    root = scratch_path(spark, "nullperiod")
    old = _events(spark, [(None, "a", 10, 1), (None, "b", 20, 1), (DAY, "a", 1, 1)])
    write_table(build_fact(FACT, {"e": old}), f"{root}/fact", partition_by=["period"])
    touched = refresh_partitioned_fact(FACT, f"{root}/fact", {"e": _events(spark, [(None, "a", 5, 1), (DAY + dt.timedelta(1), "c", 2, 1)])}, f"{root}/s1")
    assert touched == [dt.date(2024, 1, 2), None]
    assert _read(spark, f"{root}/fact") == sorted(map(str, [
        (None, "a", 15.0, 2), (None, "b", 20.0, 1), (dt.date(2024, 1, 1), "a", 1.0, 1), (dt.date(2024, 1, 2), "c", 2.0, 1)]))


def test_empty_delta_and_replay_change_nothing(spark):
    root = scratch_path(spark, "emptydelta")
    write_table(build_fact(FACT, {"e": _events(spark, [(DAY, "a", 1, 1)])}), f"{root}/fact", partition_by=["period"])
    before = _read(spark, f"{root}/fact")
    assert refresh_partitioned_fact(FACT, f"{root}/fact", {"e": _events(spark, [(DAY, "a", 1, 1)]).limit(0)}, f"{root}/s1") == []
    assert _read(spark, f"{root}/fact") == before
    more = {"e": _events(spark, [(DAY, "a", 4, 1)])}
    refresh_partitioned_fact(FACT, f"{root}/fact", more, f"{root}/s2")
    once = _read(spark, f"{root}/fact")
    _stage_and_overwrite(spark, FACT, f"{root}/fact", more, f"{root}/s2", None)  # the stage is complete: only the overwrite repeats
    assert _read(spark, f"{root}/fact") == once == [str((dt.date(2024, 1, 1), "a", 5.0, 2))]


def test_averages_do_not_depend_on_the_plan(spark):
    big = 9_223_372_036_854_775_807
    rows = spark.createDataFrame([(k, None, big, 1) for k in (1, 1, 2)] + [(1, None, big - 4, 1)], "k int, p decimal(12,2), n bigint, one int")
    rows = rows.withColumn("p", (F.col("one") * F.lit(2) / F.lit(7)).cast("decimal(12,2)"))
    dims = spark.createDataFrame([(1, "x"), (2, "x")], "id int, name string")
    fact = Fact("f", ("r",), (Metric("p", "avg", "p"), Metric("n", "avg", "n")), ("k",), key_map={"k": "d"})
    spec = MartSpec("m", (fact,), (Dimension("d", "d", "id", ("name",)),))
    got = [star_rollup(fact, {"r": rows, "d": dims}, spec, ["name"], broadcast_rows=b).collect() for b in (10**6, 0)]
    assert got[0] == got[1] and got[0][0]["p"] == pytest.approx(0.29) and got[0][0]["n"] == pytest.approx(float(big))


def test_average_merges_from_its_states(spark):
    fact = Fact("f", ("e",), (Metric("mean", "avg", "n"), Metric("kinds", "count_distinct", "kind", approximate=True)), (), time_column="t", time_grain="daily")
    a, b = _events(spark, [(DAY, "a", 1, 1), (DAY, "b", 1, 2)]), _events(spark, [(DAY, "b", 1, 9)])
    merged = merge_fact(build_fact(fact, {"e": a}, states=True), build_fact(fact, {"e": b}, states=True), fact, a.withColumn("period", F.lit(None)))
    assert [(r["mean"], r["kinds"]) for r in merged.collect()] == [(4.0, 2)]
    with pytest.raises(NonAdditiveMetricError):
        merge_fact(build_fact(fact, {"e": a}), build_fact(fact, {"e": b}), fact, a)


def test_year_from_is_pushed_for_timestamps(spark):
    path = scratch_path(spark, "ts")
    spark.sql("SELECT timestamp'1999-06-01 00:00:00' AS ts UNION ALL SELECT timestamp'2001-01-01 00:00:00' UNION ALL SELECT NULL").write.parquet(path)
    df = apply_filters(spark.read.parquet(path), {"year_from": "2001"}, "ts")
    assert "GreaterThanOrEqual(ts" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1


def test_tables_are_listed_in_any_store(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/mytable.parquet")
    (tmp_path / "notes.txt").write_text("no table")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        t = load_tables(spark, root)
        assert list(t) == ["mytable"] and t["mytable"].count() == 3


def _shares(df, partitions=16):
    """Share of the rows in the fullest partition."""
    n = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return n[-1] / sum(n)


@pytest.fixture
def no_aqe(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("hot", [None, 7])
@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_hot_or_null_key_is_spread(spark, no_aqe, hot, how):
    left = spark.range(60_000).select("id", F.when(F.col("id") % 10 < 6, F.lit(hot)).otherwise(F.col("id") % 500 + 1000).cast("int").alias("k"))
    right = spark.range(1000, 1400).select(F.col("id").cast("int").alias("rk"), F.lit("v").alias("v"))
    got = skew_split_join(left, right, ["k"], ["rk"], how)
    want = left.join(right, left["k"] == right["rk"], how)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert _shares(got) < 0.2 < _shares(want)


def test_rows_of_a_hot_duplicate_key_are_spread(spark, no_aqe):
    df = spark.range(50_000).select("id", F.when(F.col("id") % 10 < 6, 1).otherwise(F.col("id") + 10).alias("k"))
    rows = checks.duplicate_key_rows(df, "k")
    assert rows.count() == 30_000 and _shares(rows) < 0.2


def test_texts_are_measured_before_a_broadcast(spark):
    wide = spark.range(2000).select("id", F.repeat(F.lit("x"), 60_000).alias("text"))
    assert fits_broadcast(wide.select("id"), 10**6) and not fits_broadcast(wide, 10**6)
    plan = wide._jdf.queryExecution().toString()
    assert "GlobalLimit" not in plan


def test_composite_keys_one_row_per_column(spark):
    t = {"a": spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 1, "x"), (2, 2, "x")], "p int, q int, r string"),
         "b": spark.createDataFrame([(1, 1), (2, 1)], "id int, z int"),
         "c": spark.createDataFrame([(1, None), (2, 1)], "m int, n int").union(spark.createDataFrame([(1, 1)], "m int, n int"))}
    rows = [(r["table_name"], r["key_columns"], r["ordinal"], r["column_name"]) for r in discover.key_columns(t).orderBy("table_name", "ordinal").collect()]
    assert rows == [("a", "p,q", 1, "p"), ("a", "p,q", 2, "q"), ("b", "id", 1, "id")]
    three = spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "a int, b int, c int")
    assert discover.key_columns({"t": three}).count() == 0
    assert [r["column_name"] for r in discover.key_columns({"t": three}, max_width=3).orderBy("ordinal").collect()] == ["a", "b", "c"]


def test_integer_measures_are_proposed(spark):
    t = {"dim": spark.createDataFrame([(i, f"n{i}") for i in range(100, 105)], "d_id int, d_name string"),
         "sales": spark.createDataFrame([(i, 100 + i % 5, 7 * (i % 3)) for i in range(40)], "s_no int, s_id int, qty int")}
    rows = discover.star_candidates(t).collect()
    assert [(r["fact_table"], r["fact_key"], r["dimension_table"], r["n_measures"]) for r in rows] == [("sales", "s_id", "dim", 1)]
    spec = discover.propose_marts(t)[0]
    assert [m.name for m in spec.facts[0].metrics] == ["sum_qty", "row_count"]


def test_foreign_keys_without_a_comparable_pair(spark):
    t = {"a": spark.createDataFrame([(1, "x")], "i int, s string")}
    assert discover.foreign_keys(t, [("a", "i", "a", "s")]).count() == 0 and discover.foreign_keys(t, []).count() == 0


def test_ambiguous_attribute_is_an_error(spark):
    t = {"r": spark.createDataFrame([(1, 2, 3.0)], "buyer int, seller int, v double"),
         "b": spark.createDataFrame([(1, "B")], "id int, name string"), "s": spark.createDataFrame([(2, "S")], "id int, name string")}
    fact = Fact("f", ("r",), (Metric("v", "sum", "v"),), ("buyer", "seller"), key_map={"buyer": "db", "seller": "ds"})
    spec = MartSpec("m", (fact,), (Dimension("db", "b", "id", ("name",)), Dimension("ds", "s", "id", ("name",))))
    with pytest.raises(IntentError, match="more than one way"):
        star_rollup(fact, t, spec, ["name"])


def test_published_value_that_the_source_lacks_fails(spark):
    t = load_tables(spark, SF_SMALL)
    d = Dimension("dim_customer", "customer", "c_custkey", ("c_mktsegment",))
    spec = MartSpec("m", (), (d,))
    built = t["customer"].select("c_custkey", F.when(F.col("c_custkey") == 1, "NOWHERE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    bad = checks.failures(checks.check_report(spec, t, built={"dim_customer": built}))
    assert [(b["column_name"], b["check_name"], b["n_violations"]) for b in bad] == [("c_mktsegment", "accepted_values", 1)]
