import hashlib
import zlib

import numpy as np
import pytest

from starmart.llm import periodic_runs, queries

from .conftest import SMALL


def brute_lyndon(s):
    n = len(s)
    return [max(j - i for j in range(i + 1, n + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(n)]


def brute_runs(s, least):
    """Every stretch with a smallest period, by trying all periods."""
    n, out = len(s), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            w = s[i : j + p]
            if j > i and len(w) >= max(2 * p, least) and not any(w[q:] == w[:-q] for q in range(1, p)):
                out.add((i, len(w), p))
            i = j + 1
    return sorted(out)


def collapsed(words, found):
    drop = {i for start, length, period in found for i in range(start + period, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in drop)


def test_lyndon_arrays_and_runs():
    rng = np.random.default_rng(0)
    for _ in range(800):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 30))
        ranks = np.unique(s, return_inverse=True)[1]
        assert periodic_runs.lyndon_lengths(ranks).tolist() == brute_lyndon(ranks.tolist())
        least = int(rng.integers(2, 13))
        assert [tuple(r) for r in periodic_runs.runs(s, least).tolist()] == brute_runs(s.tolist(), least)


def test_hash_meetings_change_nothing(monkeypatch):
    """With hashes modulo 5 and 7 most extensions come out too long; the result stays exact."""
    monkeypatch.setattr(periodic_runs, "_PRIMES", (5, 7))
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(0, 3, rng.integers(2, 60))
        assert [tuple(r) for r in periodic_runs.runs(s, 4).tolist()] == brute_runs(s.tolist(), 4)


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_parts_lose_no_run(least):
    rng = np.random.default_rng(least)
    for _ in range(30):
        texts = []
        for _ in range(4):
            s = rng.integers(0, rng.integers(1, 40), rng.integers(0, 120))
            if len(s) > 40:  # repeat a stretch
                a, p = int(rng.integers(0, len(s) - 20)), int(rng.integers(1, 15))
                for i in range(a, min(len(s), a + int(rng.integers(4, 60)))):
                    s[i] = s[a + (i - a) % p]
            texts.append([b"%d" % x for x in s])
        for words, (found, text) in zip(texts, periodic_runs._searched(texts, least)):
            want = brute_runs(words, least)
            assert [tuple(r) for r in found.tolist()] == want and text == collapsed(words, want)


def test_time_grows_with_the_words():
    """Long texts of one word, of a cycle, and of two words at random: seconds, not squares."""
    n = 100_000
    for s, runs in ((np.zeros(n, int), [(0, n, 1)]), (np.arange(n) % 777, [(0, n, 777)])):
        assert [tuple(r) for r in periodic_runs.runs(s, 12).tolist()] == runs
    assert len(periodic_runs.runs(np.random.default_rng(2).integers(0, 2, n), 12)) > 1000


def test_query_against_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    docs = documents.select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        r = got[doc_id]
        if n > 500:  # the plain search takes too long
            assert r["n_runs"] > 0 or h % 10
            continue
        want = brute_runs(words, 12)
        some += len(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, want)).hexdigest()
    assert some > 20


def test_nasty_rows(spark, nasty):
    got = periodic_runs.find_runs(nasty.withColumnRenamed("lang", "runs")).collect()
    assert len(got) == nasty.count() and set(got[0].asDict()) == {"doc_id", "text", "runs", "source", "n_chars", "size", "score", "kept", "ids", "collapsed"}
    by = {r["n_chars"]: r for r in got}
    assert by[0]["runs"] == [] and by[0]["collapsed"] == "" and by[None]["collapsed"] == ""
    words = next(r for r in got if r["doc_id"] == 5)
    assert [tuple(x) for x in words["runs"]] == [(0, 160_000, 4 * 97 * 13)] and len(words["collapsed"].split()) == 4 * 97 * 13
    longer = next(r for r in got if r["doc_id"] == 6)
    assert [tuple(x) for x in longer["runs"]] == [(0, 160_000, 4 * 97 * 13)] and longer["collapsed"].endswith(" end")
    assert next(r for r in got if r["doc_id"] == 8)["collapsed"] == "x" * 200_000
    assert next(r for r in got if r["doc_id"] == 9)["collapsed"] == "tail"
    assert periodic_runs.find_runs(nasty.limit(0)).count() == 0
