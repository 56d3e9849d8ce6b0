import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from starmart.llm import mixing, queries

from .conftest import SMALL


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds most x size is shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_targets_and_words(spark, documents):
    rows = queries.op7_mixing(spark, SMALL).collect()
    assert len(rows) == documents.count()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in documents.collect()}
    per, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        per[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    expected = brute_targets(per)
    longest = max(size.values())
    for s in per:
        assert math.isclose(target[s], expected[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
    assert all(r["source_size"] == per[r["source"]] for r in rows)
    again = queries.op7_mixing(spark, SMALL).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_sources_that_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 7, "é": 40, "Z": 3000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_unequal_weights_favour_heavy_documents(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c d e").alias("text"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    df = df.union(spark.range(4000, 6000).select("id", F.lit("t"), F.lit("a b c d e"), F.lit(1.0)))
    got = mixing.mix(df, weights=(1, 4), weight_col="w").where("source = 's'")
    heavy, light = (got.where(F.col("doc_id") % 2 == k).agg(F.sum("taken")).first()[0] for k in (0, 1))
    target = got.first()["target"]
    assert abs(heavy + light - target) <= 5 and 2.4 < heavy / light < 3.6


def test_nasty_rows(nasty):
    rows = mixing.mix(nasty)
    assert dict(rows.dtypes)["size"] == "bigint" and rows.columns.count("size") == 1 and rows.count() == nasty.count()
    assert rows.where("text is null and (size <> 0 or taken <> 0)").count() == 0
    assert rows.where("copies < 0 or copies > 3 or size is null or taken is null").count() == 0
    copies = rows.agg(F.sum("copies")).first()[0]
    assert mixing.repeat(rows).count() == copies
    assert mixing.mix(nasty.limit(0)).count() == 0


def test_repeated_rows_reach_the_target(spark):
    df = spark.createDataFrame([(1, "one two three", "a")] * 500 + [(2, "four five", "b")] * 900, "doc_id long, text string, source string")
    rows = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 for r in rows)
