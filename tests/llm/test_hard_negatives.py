import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.llm import hard_negatives, queries

from .conftest import SMALL

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=20, positives=5, negatives=5, low=80):
    """Over (id, vector, label) rows, by the definition."""
    out = []
    for q, (qi, qv, ql) in enumerate(rows):
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i, label) for r, (i, v, label) in enumerate(rows) if r != q)
            for s, p in [(-s, i) for s, i, label in scored if label == ql][:positives]:
                inside = [(-t, i) for t, i, label in scored if label != ql and low * s <= -100 * t <= 100 * s][:negatives]
                out += [(qi, p, n + 1, i, float(s), float(t)) for n, (t, i) in enumerate(inside)]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled():
    """Random vectors, a vector that many rows repeat under two labels, and a label that a third of all rows bear."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in np.floor(rng.normal(size=6) * 30)], "hot" if i % 3 == 0 else str(rng.integers(4))) for i in range(700)]
    return rows + [(1000 + i, [5.0, 1.0, 0.0, 0.0, 2.0, 9.0], "hot" if i % 2 else "2") for i in range(200)]


@pytest.mark.parametrize("size", [dict(), dict(block=16, hot_share=0.1), dict(positives=3, negatives=2, low_percent=50)])
def test_against_brute_force(spark, labelled, size):
    df = spark.createDataFrame(labelled, "id long, vector array<double>, label string").repartition(5)
    got = hard_negatives.mine(df, F.col("id") % 20 == 0, **size)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(labelled, **{k.replace("low_percent", "low"): v for k, v in size.items() if k not in ("block", "hot_share")})


def test_hot_label_is_dealt_evenly(spark):
    """A label of a third of the rows fills no block beyond its size, and several partitions, with adaptive execution off."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("g"), F.pmod(F.xxhash64("id"), F.lit(20)).alias("part"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packed = hard_negatives._packed(rows, "rows", 100, ["g", "part"], ["id"])
        got = packed.select(F.size("rows").alias("n"), "g", F.spark_partition_id().alias("task")).where("g = 1").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["n"] for r in got) == 2001 and max(r["n"] for r in got) <= 100 and len({r["task"] for r in got}) >= 5


def test_keys_sort_as_values(spark):
    rng = np.random.default_rng(3)
    n = 500
    anchor, uid = rng.integers(-3, 3, n), rng.integers(0, 2, n)
    score = rng.choice(np.array([-1e9, -2.5, -0.0, 0.0, 1.0, 3e8]), n)
    ids = rng.integers(-(1 << 62), 1 << 62, n)
    packed = hard_negatives.pack(anchor, uid, score, 1, ids)
    keys = [packed[i : i + 33] for i in range(0, len(packed), 33)]
    values = list(zip(anchor.tolist(), uid.tolist(), score.tolist(), [1] * n, ids.tolist()))
    assert [hard_negatives.unpack(k) for k in keys] == values
    assert [hard_negatives.unpack(k) for k in sorted(keys)] == sorted(values, key=lambda v: (v[0], v[1], -v[2], v[3], v[4]))


def test_windows_hold_no_rows():
    """The iterator answers a positive's negatives as they come: it takes them from an endless stream."""
    def endless():
        yield hard_negatives.pack(np.array([1]), np.array([0]), np.array([100.0]), 0, np.array([7]))
        i = 0
        while True:
            yield hard_negatives.pack(np.array([1]), np.array([0]), np.array([99.0]), 1, np.array([i]))
            i += 1

    stream = hard_negatives.windows(endless(), 5, 80)
    assert [next(stream)[2:4] for _ in range(5)] == [(n + 1, n) for n in range(5)]


def test_nasty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [10.0, 0.0], "a"), (0, [10.0, 0.0], "a"), (1, [9.0, 0.0], "b"), (2, [10.0], "b"), (3, None, "a"), (4, [nan, 1.0], "b"), (5, [None, 1.0], "b"),
            (6, [inf, 1.0], "a"), (None, [10.0, 0.0], "b"), (8, [10.0, 0.0], None), (20, [-1.0, 0.0], "b"), (40, [0.0, 1.0], "only"), (60, [], "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, v array<double>, label string, rank string, anchor_id int")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 20 == 0, id_col="vec_id", vec_col="v").collect())
    twice = [(0, 0, 1, 2, 100.0, 100.0), (0, 0, 2, 1, 100.0, 90.0)] * 2   # each of the equal rows has the other as positive
    zero = [(0, 60, 1, 40, 0.0, 0.0)] * 2                                 # a score of 0 is matched by 0
    sixty = [(60, 0, n + 1, i, 0.0, 0.0) for n, i in enumerate([1, 2, 20, 40])] * 2
    assert got == sorted(twice + zero + sixty)
    assert hard_negatives.mine(df.limit(0), F.lit(True), id_col="vec_id", vec_col="v").count() == 0


def test_query_matches_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    cur = con.execute(queries.ORACLE_SQL["op11_hard_negatives"])
    assert [d[0] for d in cur.description] == COLUMNS
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, SMALL).collect()) == sorted(cur.fetchall())
