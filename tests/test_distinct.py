"""Exact distinct counts that merge."""

import datetime as dt
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.errors import NonAdditiveMetricError
from starmart.operators import distinct
from starmart.operators.facts import build_fact
from starmart.sinks.publish import write_table
from starmart.spec import Fact, Metric
from starmart.streaming.incremental import read_current, refresh_fact, start_fact_stream, write_fact


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def numbers(spark):
    """Dense, scattered, negative and missing numbers; one group holds most rows."""
    rng = np.random.default_rng(4)
    data = [("hot", int(x)) for x in rng.integers(-50_000, 90_000, 30_000)] + [("wide", int(x)) for x in rng.integers(-(1 << 62), 1 << 62, 300)]
    data += [(None, int(x)) for x in rng.integers(0, 40, 100)] + [("none", None), ("hot", None)]
    return spark.createDataFrame(data, "g string, n long").repartition(7)


def test_sets_count_as_the_values_do(numbers):
    sets = distinct.distinct_sets(numbers, ["g"], F.col("n")).cache()
    want = rows(numbers.groupBy("g").agg(F.count_distinct("n").alias("d")).where("d > 0"))
    assert rows(distinct.count_sets(sets, ["g"], "d")) == want
    # few positions as numbers, many as a bitmap, never both
    kinds = {(r["positions"] is None, r["bits"] is None) for r in sets.collect()}
    assert kinds == {(True, False), (False, True)}
    assert sets.groupBy("g", "bucket").count().where("count > 1").count() == 0
    assert sets.agg(F.max(F.size("positions"))).first()[0] <= distinct.FEW
    total = distinct.count_sets(distinct.merge_sets(sets, []), [], "d").first()[0]
    assert total == numbers.select("n").distinct().where("n is not null").count()


def test_merging_halves_gives_the_whole(numbers):
    half = lambda i: distinct.distinct_sets(numbers.where(F.pmod(F.hash("n"), F.lit(2)) == i), ["g"], F.col("n"))
    both = half(0).unionByName(half(1)).unionByName(half(0))
    assert rows(distinct.count_sets(distinct.merge_sets(both, ["g"]), ["g"], "d")) == rows(distinct.count_sets(distinct.distinct_sets(numbers, ["g"], F.col("n")), ["g"], "d"))


def _moved(df):
    """Bytes that the exchanges of ``df`` were given, once it has run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if kind == "ShuffleExchangeExec":
            total += node.metrics().get("dataSize").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_few_numbers_move_as_such(spark):
    rows = spark.range(4_000).select((F.col("id") % 2_000).alias("g"), (F.col("id") * 1_000_003).alias("n"))
    sets = distinct.distinct_sets(rows, ["g"], F.col("n"))
    assert 0 < _moved(sets) < 4_000 * 500  # not 4 KB a group
    assert distinct.count_sets(sets, ["g"], "d").where("d = 2").count() == 2_000


def test_empty_sets(numbers):
    none = distinct.distinct_sets(numbers.limit(0), ["g"], F.col("n"))
    assert distinct.count_sets(none, ["g"], "d").count() == 0 and distinct.count_sets(none, [], "d").first()[0] == 0


def test_types_that_are_numbers(spark):
    when, day, price = dt.datetime(2024, 3, 4, 5, 6, 7, 89), dt.date(1960, 1, 1), decimal.Decimal("-12.34")
    df = spark.createDataFrame([(1, day, when, price, True, "x"), (None,) * 6], "i int, d date, t timestamp_ntz, p decimal(10,2), b boolean, s string")
    for c in "idtpb":
        got = [r[0] for r in df.select(distinct.own_number(c, df.schema[c].dataType)).collect()]
        assert isinstance(got[0], int) and got[1] is None
    assert distinct.own_number("s", df.schema["s"].dataType) is None


def test_ids_are_dense_and_only_grow(spark, monkeypatch):
    monkeypatch.setattr(distinct, "_IDS_PER_BUCKET", 10)
    first = distinct.value_ids(spark.range(55).select(F.concat(F.lit("v"), "id").alias("x"))).cache()
    assert sorted(r["id"] for r in first.collect()) == list(range(1, 56))
    more = distinct.value_ids(spark.range(100).select(F.concat(F.lit("v"), "id").alias("x")), first)
    assert sorted(r["id"] for r in more.collect()) == list(range(1, 101))
    assert set(rows(first)) <= set(rows(more))
    again = distinct.value_ids(spark.range(55).repartition(5).select(F.concat(F.lit("v"), "id").alias("x")))
    assert rows(again) == rows(first)


FACT = Fact("f", ("t",), (Metric("users", "count_distinct", "u"), Metric("names", "count_distinct", "s"), Metric("n", "count"), Metric("mean", "avg", "u")), ("k",))
SCHEMA = "k string, u int, s string"


def test_refresh_and_stream_equal_a_rebuild(spark, tmp_path):
    batches = [[("a", 1, "x"), ("a", 1, None), ("b", 2, "y")], [("a", 2, "y"), (None, 7, "z"), ("b", 2, "y")], [("c", None, None), ("a", 1, "w")]]
    seen, src = [], f"{tmp_path}/src"
    for i, batch in enumerate(batches):
        seen += batch
        new = spark.createDataFrame(batch, SCHEMA)
        if i == 0:
            write_fact(FACT, {"t": new}, f"{tmp_path}/0")
        else:
            refresh_fact(FACT, f"{tmp_path}/{i - 1}", {"t": new}, f"{tmp_path}/{i}")
        new.coalesce(1).write.mode("append").parquet(src)
        start_fact_stream(spark, FACT, "t", src, new.schema, f"{tmp_path}/mart", f"{tmp_path}/cp").awaitTermination()
        want = rows(build_fact(FACT, {"t": spark.createDataFrame(seen, SCHEMA)}))
        assert rows(spark.read.parquet(f"{tmp_path}/{i}").select("k", "users", "names", "n", "mean")) == want
        assert rows(read_current(spark, f"{tmp_path}/mart").select("k", "users", "names", "n", "mean")) == want


def test_without_sets_a_distinct_count_does_not_merge(spark, tmp_path):
    tables = {"t": spark.createDataFrame([("a", 1, "x")], SCHEMA)}
    write_table(build_fact(FACT, tables), f"{tmp_path}/0")
    with pytest.raises(NonAdditiveMetricError):
        refresh_fact(FACT, f"{tmp_path}/0", tables, f"{tmp_path}/1")


def test_merging_few_numbers_moves_them_as_such(spark):
    """Many small sets of one group, spread over tasks, beside a bitmap and a missing key."""
    many = spark.range(6_000).select((F.col("id") % 50).alias("k"), F.lit("a").alias("g"), (F.pmod(F.col("id"), F.lit(3_000)) * 40_009).alias("n"))
    dense = spark.range(2_000).select(F.lit(7).cast("long").alias("k"), F.lit("a").alias("g"), F.col("id").alias("n"))
    lone = spark.createDataFrame([(7, None, 40_009), (8, None, 3), (9, None, 3)], "k long, g string, n long")
    numbers = many.unionByName(dense).unionByName(lone)
    fine = distinct.distinct_sets(numbers, ["k", "g"], F.col("n")).repartition(12, "k").cache()
    assert fine.where("bits is not null").count() == 1
    merged = distinct.merge_sets(fine, ["g"])
    assert 0 < _moved(merged) < 6_000 * 300  # not 4 KB a bucket and task
    assert rows(distinct.count_sets(merged, ["g"], "d")) == rows(numbers.groupBy("g").agg(F.count_distinct("n").alias("d")))
    assert merged.where("bits is not null").count() == 1 and merged.groupBy("g", "bucket").count().where("count > 1").count() == 0


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks of 500 rows, so that a few thousand rows are many."""
    from starmart import session
    from starmart.operators import facts

    for module in (session, distinct, facts):
        monkeypatch.setattr(module, "ROWS_PER_TASK", 500)


def _read_side(df):
    """The plan below the last exchange that deals out what was read (bitmaps are merged by sorting)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    return plan[plan.rindex("REPARTITION_BY_NUM"):]


def test_a_task_does_not_group_all_that_it_read(numbers, small_tasks):
    """A task reads a whole file or bucket: what it holds must not grow with that."""
    read = numbers.coalesce(1)
    want = rows(numbers.groupBy("g").agg(F.count_distinct("n").alias("d")).where("d > 0"))
    sets = distinct.distinct_sets(read, ["g"], F.col("n"))
    assert "HashAggregate" not in _read_side(sets) and rows(distinct.count_sets(sets, ["g"], "d")) == want
    assert sets.groupBy("g", "bucket").count().where("count > 1").count() == 0
    fine = distinct.distinct_sets(read.withColumn("k", F.pmod("n", F.lit(900))), ["k", "g"], F.col("n")).repartition(8, "k").localCheckpoint().coalesce(1)
    merged = distinct.merge_sets(fine, ["g"])
    assert "HashAggregate" not in _read_side(merged.where("positions is not null")) and rows(distinct.count_sets(merged, ["g"], "d")) == want
    bitmaps = distinct.merge_sets(sets.unionByName(fine.drop("k")), ["g"])  # beside the few, sets that were bitmaps
    assert rows(distinct.count_sets(bitmaps, ["g"], "d")) == want


def test_few_values_are_still_combined_where_they_are_read(spark, small_tasks):
    read = spark.range(5_000, numPartitions=1).select(F.lit("a").alias("g"), (F.col("id") % 5).alias("n"))
    sets = distinct.distinct_sets(read, ["g"], F.col("n"))
    assert "REPARTITION_BY_NUM" not in sets._jdf.queryExecution().executedPlan().toString()
    assert rows(distinct.count_sets(sets, ["g"], "d")) == [("a", 5)]


def test_the_right_side_of_a_join_is_grouped_in_small_tasks(spark, small_tasks):
    from starmart.plans.joins import row_count, unique_on

    right = spark.range(3_000, numPartitions=1).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    row_count(right)  # as the size check does
    unique = unique_on(right, ["k"], "t")
    assert "HashAggregate" not in _read_side(unique) and unique.agg(F.sum("v")).first()[0] == 2_999 * 3_000
    twice = right.unionByName(right.limit(1))
    row_count(twice)
    with pytest.raises(Exception, match="not unique"):
        unique_on(twice, ["k"], "t").collect()


def test_hot_keys_are_counted_by_hash_first(spark):
    """Many keys make a bounded number of groups; only a hot hash's keys are counted."""
    from starmart.plans.joins import _key_shares

    left = spark.range(150_000, numPartitions=1).select(F.when(F.col("id") % 10 == 0, F.lit(-1)).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"))
    assert _key_shares(left, ["k"], 0.05) == ([(-1,)], True)
    assert _key_shares(left.where("k >= 0"), ["k"], 0.05) == ([], False)


def test_published_in_small_tasks_counts_the_same(spark, small_tasks, tmp_path):
    """A fact of two tables with hot, missing and orphan keys, texts and numbers."""
    from starmart.sinks.catalog import publish_to_catalog, rollup_published
    from starmart.spec import Dimension, Join, MartSpec

    orders = spark.range(4_000, numPartitions=1).select(F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 700).alias("c"),
                                                        F.concat(F.lit("p"), F.col("id") % 5).alias("prio"))
    lines = spark.range(9_000, numPartitions=1).select((F.col("id") % 4_100).alias("lo"), (F.col("id") % 1_777 * 40_009).alias("part"))
    tables = {"orders": orders, "lines": lines, "cust": spark.range(700).select(F.col("id").alias("ck"), (F.col("id") % 4).cast("string").alias("seg"))}
    fact = Fact("f", ("lines", "orders"), (Metric("parts", "count_distinct", "part"), Metric("n", "count"), Metric("prios", "count_distinct", "prio"), Metric("orders", "count_distinct", "o")),
                ("c",), joins=(Join("orders", "lo", "o"),), key_map={"c": "dim_cust"})
    spec = MartSpec("small", (fact,), (Dimension("dim_cust", "cust", "ck", ("seg",)),))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.starmart.broadcast.maxRows", "1000")  # orders are joined by a shuffle
    try:
        publish_to_catalog(spec, tables, "small_tasks", f"{tmp_path}/db", buckets=4, check=False)
        got = rows(rollup_published(spark, spec, "small_tasks", "f", ["seg"], tables=tables).select("seg", "parts", "n", "prios", "orders"))
    finally:
        spark.conf.unset("spark.starmart.broadcast.maxRows")
    assert {k: spark.conf.get(k, None) for k in before} == before
    seg = tables["cust"].withColumnRenamed("ck", "c")
    a = lines.join(orders, lines["lo"] == orders["o"], "left").join(seg, "c", "left").groupBy("seg").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"))
    b = orders.join(seg, "c", "left").groupBy("seg").agg(F.count_distinct("prio").alias("prios"), F.count_distinct("o").alias("orders"))
    assert got == rows(a.join(b, a["seg"].eqNullSafe(b["seg"])).select(a["seg"], "parts", "n", "prios", "orders"))


def test_tasks_grow_with_the_rows(spark):
    from starmart.session import tasks_for

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tasks_for(spark, n * 1_000_000) for n in (0, 1, 150, 216, 600, 1_200)] == [own, own, max(own, 150), max(own, 200), max(own, 200), max(own, 400)]
