"""Periodic runs in texts, by Baier's grouping.

A run is a maximal stretch of words with a smallest period: words that many places
apart are identical, and no neighbouring word extends it.  Every run has a Lyndon root
that is the longest Lyndon word at its start under an order of the words or under the
reversed order, so the Lyndon arrays of both orders hold all candidates.

Phase one of Baier's suffix sorter gives a Lyndon array directly: suffixes start out
grouped by their first word; groups are handled from the highest down, and each suffix
of a group joins its context to that of the nearest lower suffix on its left, which
moves to a new group just above its own.  A group's context length, when its turn
comes, is the length of the longest Lyndon word at its suffixes.  Those lower suffixes
are the ones not handled yet, so a linked list of these gives each in one step.

Each (place, root length) is extended to both sides by longest common extensions,
which binary search on prefix hashes finds for all candidates at once; a root whose
extended stretch holds it twice is a run.  Hashes only ever find extensions too long,
so each run is compared word by word at the end, and walked if that fails: the result
is exact.

Parts without a run are cut out before.  With k half of ``min_length``, all k-grams of
a run occur again in it but for fewer than k neighbouring ones, which have others on
both sides; so a run never reaches across k neighbouring k-grams that occur once, and
what lies between such places is a part of its own, in which the same holds again.
The suffix sorter then sees only parts that repeat themselves.

The work is map-only: texts are handled about a million words at a time, and a long
text by itself, in memory proportional to its words.

Defined results: a null or empty text has no words, no runs and an empty collapsed
text; words are compared byte by byte; texts stand for themselves, so ties and repeated
rows need no care; an empty table gives an empty table; other columns pass through, and
one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_HELD = 1 << 20  # words searched at once
_PRIMES = (2147483647, 2147483629)
_BASES = (1000003, 998244353)
_MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = ArrayType(StructType([StructField(f, LongType()) for f in ("start", "length", "period")]))


# -- Lyndon arrays ------------------------------------------------------------

def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by phase one of Baier's sorter.

    ``ranks`` are 0 .. m - 1, all of them in use."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    firsts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
    members = [part.tolist() for part in np.split(order, firsts[1:])]
    group = ranks.tolist()
    length = [1] * len(members)       # of each group's context
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    top = len(members) - 1
    left = list(range(-1, n))         # neighbours among the suffixes not handled, with a guard at n
    right = list(range(1, n + 2))
    result = [0] * n
    while top >= 0:
        size, pointed = length[top], {}
        for i in members[top]:
            if group[i] != top:
                continue              # has moved up since
            group[i] = -1             # a suffix is handled once
            result[i] = size
            p, q = left[i], right[i]
            left[q] = p
            if p >= 0:
                right[p] = q
                pointed[p] = pointed.get(p, 0) + 1
        members[top] = ()
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moved.setdefault((group[p], -times), []).append(p)
        for old, times in sorted(moved):  # of one old group the most often pointed at go highest
            new, over = len(members), above[old]
            members.append(moved[old, times])
            length.append(length[old] - times * size)
            below.append(old)
            above.append(over)
            above[old] = new
            if over >= 0:
                below[over] = new
            for p in members[new]:
                group[p] = new
        top = below[top]
    return np.array(result, np.int64)


# -- longest common extensions ------------------------------------------------

class _Hashes:
    """Prefix hashes of a sequence modulo two primes."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        self.n, self.power, self.prefix = n, [], []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(n + 1, np.int64)
            done = 1
            while done <= n:  # base ** 0 .. base ** n, doubling what is known
                step = pow(base, done, prime)
                power[done : 2 * done] = power[: min(done, n + 1 - done)] * step % prime
                done *= 2
            prefix = np.zeros(n + 1, np.int64)
            # sums of at most 2**31 terms below 2**31 stay below 2**62
            np.cumsum((s + 1) % prime * power[:n] % prime, out=prefix[1:])
            self.power.append(power)
            self.prefix.append(prefix % prime)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Do the stretches of ``size`` at a < b look equal?"""
        same = np.ones(len(a), bool)
        for prime, power, prefix in zip(_PRIMES, self.power, self.prefix):
            x = (prefix[a + size] - prefix[a]) % prime * power[b - a] % prime
            same &= x == (prefix[b + size] - prefix[b]) % prime
        return same

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Words from a and b on (``back``: before them) that look equal, ``most`` at most."""
        got = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step and len(open_):
            at = open_[got[open_] + step <= most[open_]]
            size = got[at] + step
            same = self.equal(a[at] - size, b[at] - size, size) if back else self.equal(a[at], b[at], size)
            got[at[same]] += step
            step >>= 1
        return got


def _walked(s: np.ndarray, root: int, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch of a root that hashes found too long, word by word."""
    bad = start + np.flatnonzero(s[start : end - period] != s[start + period : end])
    lo, hi = bad[bad < root], bad[bad >= root]
    return int(lo[-1]) + 1 if len(lo) else start, int(hi[0]) + period if len(hi) else end


def runs(s: np.ndarray, min_length: int = 2) -> np.ndarray:
    """(start, length, period) of every run of at least ``min_length`` words, by start and period.

    ``s``: a number for each word, equal for equal words."""
    n = len(s)
    if n < max(2, min_length):
        return np.zeros((0, 3), np.int64)
    ranks = np.unique(s, return_inverse=True)[1]
    found = []
    hashes = None
    for order in (ranks, ranks.max() - ranks):
        a = np.arange(n)
        b = a + lyndon_lengths(order)
        # a root repeats to neither side if both its neighbours differ
        some = ((b < n) & (s[a] == s[np.minimum(b, n - 1)])) | ((a > 0) & (s[np.maximum(a - 1, 0)] == s[b - 1]))
        a, b = a[some], b[some]
        if len(a):
            hashes = hashes or _Hashes(ranks)
            start = a - hashes.extension(a, b, a, back=True)
            end = b + hashes.extension(a, b, n - b, back=False)
            long = end - start >= np.maximum(2 * (b - a), min_length)
            found.append(np.stack([start, end, b - a, a], axis=1)[long])
    found = np.concatenate([np.zeros((0, 4), np.int64), *found])
    stretches, which = np.unique(found[:, :3], axis=0, return_inverse=True)
    exact = set()
    for i, (start, end, period) in enumerate(stretches.tolist()):
        if (s[start : end - period] == s[start + period : end]).all():
            exact.add((start, end - start, period))
            continue
        for root in found[which == i, 3].tolist():
            lo, hi = _walked(s, root, start, end, period)
            if hi - lo >= max(2 * period, min_length):
                exact.add((lo, hi - lo, period))
    out = np.array(list(exact), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


# -- parts that repeat themselves ---------------------------------------------

def repeating_parts(s: np.ndarray, text: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """Stretches [from, to) of one text each, outside which there is no run of ``min_length`` words.

    ``s``: a number for each word, equal for equal words of a text; ``text``: its text, ascending."""
    k = max(1, min_length // 2)
    part = text
    at = np.arange(len(s))  # places of the words that are left
    while True:
        if len(at) < k:
            return []
        # a gram's hash: equal ones of a part agree, and a chance meeting only keeps a part
        gram = np.zeros(len(at) - k + 1, np.uint64)
        for j in range(k):
            gram = (gram + (s[at[j : len(at) - k + 1 + j]].astype(np.uint64) + np.uint64(1))) * _MIX
            gram ^= gram >> np.uint64(29)
        gram = (gram + part[at[: len(gram)]].astype(np.uint64)) * _MIX
        whole = part[at[: len(gram)]] == part[at[k - 1 :]]
        order = np.argsort(gram)
        same = gram[order[1:]] == gram[order[:-1]]
        again = np.zeros(len(gram), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        good = np.flatnonzero(again & whole)
        if not len(good):
            return []
        # parts: good grams less than k + 1 apart in the same part
        new = np.ones(len(good), bool)
        new[1:] = (np.diff(good) > k) | (part[at[good[1:]]] != part[at[good[:-1]]])
        first = np.flatnonzero(new)
        lo, hi = good[first], good[np.append(first[1:], len(good)) - 1] + k
        wide = hi - lo >= min_length
        lo, hi = lo[wide], hi[wide]
        size = hi - lo
        kept = at[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        if len(kept) == len(at) or not len(kept):
            starts = np.cumsum(size) - size
            return [(int(kept[i]), int(kept[i]) + int(n)) for i, n in zip(starts, size)]
        part = np.zeros(len(s), np.int64)
        part[kept] = np.repeat(np.arange(len(size)), size)
        at = kept


# -- the operator -------------------------------------------------------------

def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The text without the words that a run holds after its first period."""
    if not len(found):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)])


def _searched(texts: list[list[bytes]], min_length: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs and collapsed text of each of some texts."""
    numbers, text = [], []
    for i, words in enumerate(texts):
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, len(known)) for w in words]
        text.append(np.full(len(words), i))
    s, row = np.array(numbers, np.int64), np.concatenate(text) if text else np.zeros(0, np.int64)
    first = np.searchsorted(row, np.arange(len(texts)))
    by_text: dict[int, list[np.ndarray]] = {}
    for lo, hi in repeating_parts(s, row, min_length):
        found = runs(s[lo:hi], min_length)
        found[:, 0] += lo - first[row[lo]]
        by_text.setdefault(int(row[lo]), []).append(found)
    none = np.zeros((0, 3), np.int64)
    for i, words in enumerate(texts):
        found = np.concatenate(by_text[i]) if i in by_text else none
        yield found, _collapsed(words, found)


def _answers(batches: Iterator[pa.Array], min_length: int) -> Iterator[pa.StructArray]:
    for batch in batches:
        found, text = [], []

        def flush(held: list[list[bytes]]) -> None:
            for r, t in _searched(held, min_length):
                found.append(r)
                text.append(t)

        held, size = [], 0
        for value in batch.cast(pa.binary()):
            words = (value.as_py() or b"").split()  # at ASCII white space
            held.append(words)
            size += len(words)
            if size >= _HELD:
                flush(held)
                held, size = [], 0
        flush(held)
        flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        ends = np.cumsum([0, *map(len, found)])
        pieces = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), pa.array(text, pa.binary()).view(pa.string())], ["runs", "collapsed"])


def find_runs(df: DataFrame, text_col: str = "text", min_length: int = 12) -> DataFrame:
    """Add ``runs`` (start, length, period in words, by start and period) and ``collapsed``, the
    text with each run cut down to its first period, words joined by one space."""
    kind = StructType([StructField("runs", RUNS), StructField("collapsed", StringType())])

    @F.arrow_udf(kind)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _answers(batches, min_length)

    found = df.withColumn("__found", search(F.col(text_col)))
    return found.withColumns({"runs": F.col("__found.runs"), "collapsed": F.col("__found.collapsed")}).drop("__found")


def longest(runs_col: str = "runs") -> Column:
    """The longest run (ties: smallest start, then period) as a struct, null without a run."""
    best = F.array_min(F.transform(runs_col, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
