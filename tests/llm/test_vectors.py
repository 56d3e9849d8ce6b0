import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.llm import embed_dedup, queries, topk

from .conftest import SMALL

VEC = "vec_id long, v array<double>, rank string, n_links string"


def brute_top(rows, k):
    """[(query, rank, id, score)] over (id, vector) rows; every row but the query's own is a candidate."""
    out = []
    for q, (qi, qv) in enumerate(rows):
        if qi % 20 == 0:
            all_ = sorted((-sum(a * b for a, b in zip(qv, v)), i) for r, (i, v) in enumerate(rows) if r != q)[:k]
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(all_)]
    return sorted(out)


def brute_links(rows, threshold):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = np.arange(len(x))
    while not (new := np.array([label[r].min() for r in near])).tolist() == label.tolist():
        label = new
    least = {}
    for (i, _), c in zip(rows, label.tolist()):
        least[c] = min(least.get(c, i), i)
    return {(i, int(n) - 1, least[c]) for (i, _), n, c in zip(rows, near.sum(axis=1), label.tolist())}


@pytest.fixture(scope="module")
def mixed():
    """Clusters, a vector that a third of all rows repeat, near copies, and ties."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 30
    vs = [np.round(centres[rng.integers(6)] + rng.normal(size=8) * 6) for _ in range(500)]
    vs += [np.round(centres[0])] * 300 + [np.round(centres[1] + (rng.random(8) < 0.2)) for _ in range(200)]
    return [(i, [float(a) for a in v]) for i, v in enumerate(vs)]


@pytest.mark.parametrize("size", [dict(), dict(rows_per_cell=10, block=16, sample=200)])
def test_top_k_against_brute_force(spark, mixed, size):
    df = spark.createDataFrame(mixed, "id long, vector array<double>").repartition(5)
    got = topk.top_k(df, F.col("id") % 20 == 0, k=7, **size).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == brute_top(mixed, 7)


@pytest.mark.parametrize("size", [dict(), dict(rows_per_cell=40, block=64, sample=300)])
@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_links_against_brute_force(spark, mixed, size, threshold):
    df = spark.createDataFrame(mixed, "id long, vector array<double>").repartition(5)
    got = embed_dedup.near_duplicates(df, threshold=threshold, **size).collect()
    assert {(r["id"], r["n_links"], r["component_id"]) for r in got} == brute_links(mixed, threshold)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got) and len(got) == len(mixed)


@pytest.mark.parametrize("name", ["op1_topk", "op2_embedding_dedup"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == cols and sorted(tuple(r) for r in df.select(*cols).collect()) == want and want


@pytest.fixture(scope="module")
def nasty_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, [1.0, 2.0]), (2, [nan, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [0.0, 0.0]), (60, [None, 1.0]),
            (80, [-inf, 1.0]), (None, [1.0, 2.0]), (100, []), (101, [3.0]), (120, [1e200, 1e200]), (121, [-1.0, -2.0])]
    return spark.createDataFrame([(i, v, "r", "n") for i, v in rows], VEC)


def test_nasty_top_k(nasty_vectors):
    got = topk.top_k(nasty_vectors.where("vec_id is null or vec_id <> 120"), F.col("vec_id") % 20 == 0, 3, "vec_id", "v").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert sorted(by) == [20, 40, 100]
    assert sorted(by[20]) == sorted([(1, 1, 5.0), (2, 20, 5.0), (3, 101, 3.0)] * 2)  # the other row of the same id is a candidate
    assert [x[1:] for x in sorted(by[40])] == [(1, 0.0), (20, 0.0), (20, 0.0)]
    assert topk.top_k(nasty_vectors.limit(0), F.lit(True), 3, "vec_id", "v").count() == 0


def test_nasty_links(nasty_vectors):
    got = embed_dedup.near_duplicates(nasty_vectors, "vec_id", "v").collect()
    assert len(got) == 13
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert by[1] == by[20] == by[None] == (3, 1)
    assert by[0] == (0, 0) and by[40] == (0, 40) and by[60] == (0, 60) and by[80] == (0, 80) and by[121] == (0, 121) and by[101] == (0, 101)
    assert by[120][1] in (1, 120)
    assert embed_dedup.near_duplicates(nasty_vectors.limit(0), "vec_id", "v").count() == 0
    assert embed_dedup.near_duplicates(nasty_vectors.where("vec_id = 40"), "vec_id", "v").count() == 1
