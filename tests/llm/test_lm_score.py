import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starmart.llm import lm_score, queries

from .conftest import SMALL


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, word_least, pair_least, mix=0.6):
    """{id: (tokens, target loss, background loss)} by plain dictionaries over (id, text, target)."""
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for _, text, target in docs:
        uni[not target].update(words_of(text))
    vocabulary = {w for w in set(uni[0]) | set(uni[1]) if uni[0][w] + uni[1][w] >= word_least}
    for _, text, target in docs:
        w = words_of(text)
        bi[not target].update(p for p in zip(w, w[1:]) if p[0] in vocabulary and p[1] in vocabulary)
    kept = {p for p in set(bi[0]) | set(bi[1]) if bi[0][p] + bi[1][p] >= pair_least}
    out = {}
    by_first = {}
    for p in kept:
        by_first.setdefault(p[0], []).append(p)
    share = [{h: sum(bi[m][p] for p in ps) / max(1, uni[m][h]) for h, ps in by_first.items()} for m in (0, 1)]
    for i, text, _ in docs:
        w, loss = words_of(text), [0.0, 0.0]
        for m in (0, 1):
            n = sum(uni[m].values())
            for k, x in enumerate(w):
                c = uni[m][x] if x in vocabulary else n - sum(uni[m][v] for v in vocabulary)
                p = (c + 1) / (n + len(vocabulary) + 1)
                h = w[k - 1] if k else None
                if h in vocabulary:
                    p = (1 - mix * share[m].get(h, 0)) * p + (mix * bi[m][h, x] / max(1, uni[m][h]) if (h, x) in kept else 0)
                loss[m] -= math.log(p)
        out[i] = (len(w), *[x / len(w) if w else None for x in loss])
    return out


@pytest.mark.parametrize("share", [1e-9, 0.004])
def test_against_brute_force(spark, documents, share):
    docs = [(r["doc_id"], r["text"], r["doc_id"] % 3 == 0) for r in documents.where("doc_id < 60").collect()] + [(900, None, True), (901, " \n", False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean").repartition(3)
    least = max(1, share * sum(len(words_of(t)) for _, t, _ in docs))
    want = brute(docs, least, least)
    got = lm_score.score(df, lm_score.fit(df, "target", word_share=share, pair_share=share)).collect()
    assert len(got) == len(docs)
    for r in got:
        n, t, b = want[r["doc_id"]]
        assert r["n_tokens"] == n
        if n:
            assert math.isclose(r["loss_target"], t, rel_tol=1e-9) and math.isclose(r["loss_background"], b, rel_tol=1e-9)
            assert math.isclose(r["score"], t - b, abs_tol=1e-9)
        else:
            assert r["score"] is None and r["loss_target"] is None


def test_chances_sum_to_one():
    rng = np.random.default_rng(2)
    size = 7
    words = np.sort(rng.integers(0, 2**63, size).astype(np.uint64))
    pairs = np.sort(rng.choice(size * size, 20, replace=False))
    pair_counts = rng.integers(0, 5, (2, 20)).astype(float)
    counts = np.stack([np.bincount(pairs // size, c, size) for c in pair_counts]) + 3
    m = lm_score.build(words, counts, counts.sum(axis=1) + 10, pairs, pair_counts, 0.6)
    unseen = np.uint64(12345)
    for h in [*words, unseen]:
        total = np.zeros(2)
        for w in [*words, unseen]:
            total += np.exp(-m.losses(np.array([h, w], np.uint64), np.array([0, 0])))[:, 1]
        assert np.allclose(total, 1)


def test_target_like_texts_score_lower(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(80)), True) for i in range(40)] + [(100 + i, " ".join(f"v{(i * 7 + k) % 50}" for k in range(80)), False) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    model = lm_score.fit(df, "target")
    new = spark.createDataFrame([(1, "w1 w2 w3 w4 w5"), (2, "v1 v2 v3 v4 v5")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(new, model).collect()}
    assert got[1] < 0 < got[2]


def test_query_scores_every_document(spark, documents):
    got = queries.op3_lm_score(spark, SMALL)
    assert got.count() == documents.count() and got.where("score is null and n_tokens > 0").count() == 0
    mean = {r["target"]: r["m"] for r in got.groupBy("target").agg(F.avg("score").alias("m")).collect()}
    assert mean[True] < mean[False]


def test_nasty_rows(nasty):
    df = nasty.withColumn("target", F.when(F.col("doc_id") > 3, True))
    out = lm_score.score(df, lm_score.fit(df, "target"))
    assert dict(out.dtypes)["score"] == "double" and out.columns.count("score") == 1 and out.count() == nasty.count()
    assert out.where("n_tokens = 0 and score is not null").count() == 0
    empty = lm_score.fit(df.limit(0), "target")
    assert lm_score.score(df, empty).where("abs(score) > 1e-12").count() == 0
    assert lm_score.score(df.limit(0), empty).count() == 0
    one = lm_score.fit(df.withColumn("target", F.lit(None).cast("boolean")), "target")
    assert lm_score.score(df, one).where("n_tokens > 0 and score is null").count() == 0


def test_parts_of_long_texts(monkeypatch):
    """Words, rows and pairs do not depend on where texts are cut."""
    import pyarrow as pa
    texts = pa.array([None, "one Two three", "", " ".join(f"w{i}" for i in range(90)), "x" * 50, "a b\n\tc  d "])
    whole = list(lm_score.batch_words(texts))
    assert len(whole) == 1 and whole[0][2] == 0
    monkeypatch.setattr(lm_score, "_PART", 8)
    parts = list(lm_score.batch_words(texts))
    assert len(parts) > 20
    assert np.concatenate([w[s:] for w, _, s in parts]).tolist() == whole[0][0].tolist()
    assert np.concatenate([r[s:] for _, r, s in parts]).tolist() == whole[0][1].tolist()
    pairs = lambda ps: sorted((int(w[i]), int(w[i + 1])) for w, r, _ in ps for i in range(len(w) - 1) if r[i] == r[i + 1])
    assert pairs(parts) == pairs(whole)


def test_rare_words_and_bigrams_count(spark):
    """By default nothing is too rare, whatever the number of tokens, with common bigrams broadcast or none."""
    common = [(i, " ".join(f"w{(i + k * k) % 89}" for k in range(3000)), i % 2 == 0) for i in range(400)]
    # the same rare words, in another order: only rare bigrams tell these apart
    docs = common + [(1000, "rare aa bb cc dd", True), (1001, "rare aa bb cc dd", True), (1002, "rare dd cc bb aa", False), (1003, "rare dd cc bb aa", False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean").repartition(3)
    want = brute(docs, 1, 1)
    model = lm_score.fit(df, "target")
    for hot_share, fitted in ((2e-6, True), (2e-6, False), (1.0, True)):
        got = {r["doc_id"]: r for r in lm_score.score(df, model, hot_share=hot_share, fitted=fitted).collect()}
        assert all(math.isclose(got[i]["score"], t - b, abs_tol=1e-9) and got[i]["n_tokens"] == n for i, (n, t, b) in want.items())
    assert got[1000]["score"] < -1 < 1 < got[1002]["score"]


def brute_corpus(docs, mix=0.6):
    """[(tokens, target loss, background loss)] of (text, target) under the corpus's own models."""
    pairs, firsts, vocabulary = (Counter(), Counter()), (Counter(), Counter()), set()
    for text, target in docs:
        w = words_of(text)
        vocabulary |= set(w)
        pairs[not target].update(zip([None, *w], w))
        firsts[not target].update([None, *w][: len(w)])
    v = len(vocabulary) + 1
    out = []
    for text, _ in docs:
        w, loss = words_of(text), [0.0, 0.0]
        for m in (0, 1):
            for h, x in zip([None, *w], w):
                loss[m] -= math.log(mix * pairs[m][h, x] / firsts[m][h] + (1 - mix) / v if firsts[m][h] else 1 / v)
        out.append((len(w), *[x / len(w) if w else None for x in loss]))
    return out


def same_losses(got, want):
    assert len(got) == len(want)
    for r, (n, t, b) in zip(got, want):
        assert r["n_tokens"] == n
        if n:
            assert all(math.isclose(r[c], x, rel_tol=1e-9, abs_tol=1e-9) for c, x in (("loss_target", t), ("loss_background", b), ("score", t - b)))
        else:
            assert r["loss_target"] is None and r["loss_background"] is None and r["score"] is None


@pytest.mark.parametrize("sizes", [dict(), dict(_COMMON=20, _CHUNK=500, _HELD=300, _BUCKET=1000), dict(_CHUNK=7, _HELD=7, _PART=64)])
def test_corpus_against_brute_force(spark, documents, monkeypatch, sizes):
    """Also with common first words dealt by the second, texts cut anywhere and many buckets; a text in many copies."""
    for name, value in sizes.items():
        monkeypatch.setattr(lm_score, name, value)
    docs = [(r["text"], r["doc_id"] % 3 == 0) for r in documents.where("doc_id < 80").collect()] + [(None, True), (" \n", False), ("", None)]
    docs += [("the same text again and again", i % 5 == 0) for i in range(40)] + [("many " * 700 + " ".join(f"many x{i}" for i in range(600)), True)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "i long, text string, target boolean").repartition(4)
    got = lm_score.score_corpus(df, "target").orderBy("i").collect()
    assert got[0].asDict().keys() == {"i", "target", "n_tokens", "loss_target", "loss_background", "score"}
    same_losses(got, brute_corpus([(t, bool(y)) for t, y in docs]))


def test_query_against_brute_force(spark, documents):
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = queries.op3_lm_score(spark, SMALL).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in docs] and [r["target"] for r in got] == [i in good for i, _ in docs]
    same_losses(got, brute_corpus([(t, i in good) for i, t in docs]))


def test_query_with_more_labels_than_a_broadcast_holds(spark):
    want = queries.op3_lm_score(spark, SMALL).orderBy("doc_id").collect()
    spark.conf.set("spark.starmart.broadcast.maxRows", "0")
    try:
        got = queries.op3_lm_score(spark, SMALL).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.starmart.broadcast.maxRows")
    assert [r["target"] for r in got] == [r["target"] for r in want]
    same_losses(got, [(r["n_tokens"], r["loss_target"], r["loss_background"]) for r in want])


def test_a_chunk_that_changed_fails(spark):
    """A task that ran again with other rows has left losses without their texts, or two sets of texts."""
    texts = np.zeros(2, lm_score._TEXT)
    texts["k1"], texts["n"] = [5, 6], [3, 4]
    sums = [lm_score._pack_sums(np.array([0, 1], np.uint32), np.array([1.0, 2.0]), np.array([3.0, 4.0])), lm_score._pack_sums(np.array([1], np.uint32), np.array([0.5]), np.array([0.25]))]
    rows = lambda keys: pa.table({"texts": pa.array([*keys, None, None], pa.binary()), "sums": pa.array([None] * len(keys) + sums, pa.binary())})
    out = lm_score._chunk_losses(rows([texts.tobytes()])).to_pydict()
    assert out == {"k1": [5, 6], "k2": [0, 0], "n": [3, 4], "t": [1.0, 2.5], "b": [3.0, 4.25]}
    for keys in ([], [texts.tobytes()] * 2):
        with pytest.raises(RuntimeError, match="ran again"):
            lm_score._chunk_losses(rows(keys))


def test_corpus_of_nasty_rows(nasty):
    df = nasty.withColumn("target", F.when(F.col("doc_id") > 3, True))
    out = lm_score.score_corpus(df, "target")
    assert dict(out.dtypes)["score"] == "double" and out.columns.count("score") == 1 and out.count() == nasty.count()
    assert out.where("n_tokens = 0 and score is not null").count() == 0 and out.where("n_tokens > 0 and score is null").count() == 0
    assert lm_score.score_corpus(df.limit(0), "target").count() == 0
    assert lm_score.score_corpus(df.where("text is null or text = ''"), "target").where("n_tokens <> 0").count() == 0


def test_squeezed_texts_come_back(spark, nasty):
    from starmart.llm.common import squeezed, unsqueezed
    small = squeezed(nasty, "text")
    assert dict(small.dtypes)["text"] == "binary" and small.agg(F.sum(F.octet_length("text"))).first()[0] < nasty.agg(F.sum(F.octet_length("text"))).first()[0] / 10
    assert sorted(map(str, unsqueezed(small, "text").collect())) == sorted(map(str, nasty.collect()))
