import random
import re

import numpy as np
import pytest
import xxhash

from starmart.llm import queries, simhash
from starmart.llm.common import connected_components

from .conftest import SMALL


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """Smallest id reachable from each row of (id, print); a null id is last."""
    key = [(i is None, i or 0) for i, _ in prints]
    p = np.array([x for _, x in prints], np.uint64)
    label = np.arange(len(p))
    near = np.bitwise_count(p[:, None] ^ p[None]) <= radius
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    low = {c: min(key[i] for i in np.flatnonzero(label == c)) for c in set(label.tolist())}
    return [None if low[c][0] else low[c][1] for c in label.tolist()]


def test_query_against_brute_force(spark, documents):
    docs = documents.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_print(r["text"])) for r in docs]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))}
    got = queries.op10_simhash(spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    assert sum(r["kept"] for r in got) == len({r["component_id"] for r in got})
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_lanes_within_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    p = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(9)])
    n = len(p)
    label = simhash.forest(p, np.arange(n) + 1, np.full(n, n), radius, chunk=50)
    near = np.bitwise_count(p[:, None] ^ p[None]) <= radius
    want = np.arange(n)
    while not (new := np.array([want[r].min() for r in near])).tolist() == want.tolist():
        want = new
    assert label.tolist() == want.tolist()


@pytest.mark.parametrize("block", [64, 8192])
def test_links_are_complete(spark, block):
    """A hot group of near fingerprints, pairs at every distance up to 6, and far ones."""
    rng = random.Random(block)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    hot = rng.getrandbits(64)
    prints = [flip(hot, rng.randrange(4)) for _ in range(700)]
    for k in range(7):
        for _ in range(60):
            x = rng.getrandbits(64)
            prints += [x, flip(x, k)]
    rows = list(enumerate(prints))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df, block=block).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)


def test_nasty_rows(nasty):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    marked = simhash.near_duplicate_groups(simhash.with_fingerprints(nasty.select("doc_id", "text", "kept", "size")))
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in marked.collect()))) == sorted(map(str, zip([i for i, _ in rows], want)))
    kept = simhash.near_dedup(nasty)
    assert kept.columns == nasty.columns and kept.count() == len(set(want))
    assert simhash.near_dedup(nasty.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 300)] + [(299, 7), (1, 1), (400, 398), (398, 399)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in (5, 7, *range(200, 300))} | {398: 398, 399: 398, 400: 398}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
