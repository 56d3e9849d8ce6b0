"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents and one of the background (all others),
share vocabulary, n-grams and smoothing; they differ in their counts only.  A
document's score is its loss per token under the target model minus that under the
background model: the lower, the more it reads like the target.

Words are runs without ASCII white space, ASCII lower-cased; a word is a 64-bit hash.
Every word and every bigram counts, however rare (``word_share`` and ``pair_share`` can
leave out those below a share of all tokens; by default nothing is).  The model grows
with the corpus, so it is two Spark tables, of bigrams and of words, and nothing that
grows is collected: tasks combine bigrams per some million words and Spark by shuffle;
word counts follow from the bigrams, whose first word is 0 at the start of a text.
Each bigram's two losses are joined from these tables once, and a document's bigrams,
combined per document, meet them in a join on the bigram's 64-bit key.  Bigrams of a
``hot_share`` of all tokens (at most 1 / hot_share of them) are broadcast and summed in
the task, so no common bigram is a large group of that join.

:func:`score_corpus` scores a corpus by models of itself in a single exchange; :func:`fit`
and :func:`score` keep a model's counts as tables to score other rows.  The latter's chances:

p(w | h) = k c(h, w) / c(h) + (1 - k s(h)) p(w), where p(w) = (c(w) + 1) / (n + v),
s(h) is the part of c(h) that the bigrams of h make up, and k is ``mix``: the chances
after each h sum to one.

Defined results: null and empty texts have 0 tokens and null losses and score; a
document is a target if the given column is true (null: not); a model without any
token gives equal chances to all words.  An empty table gives an empty table.  Other
columns pass through, and one named like an output is replaced.  Losses are sums of
doubles in no fixed order: their last digits can differ between runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.common import written
from starmart.plans.joins import skew_split_join

# Bytes: ASCII letters lower-cased; the white space that separates words.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(4095, 0x9E3779B97F4A7C15, np.uint64)]))
_COUNTS = "h long, w long, t long, b long"
_GRAMS = "__uid long, key long, n long, t double, b double"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in UTF-8 bytes."""
    space = _IS_SPACE[data]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    if not len(start):
        return np.zeros(0, np.uint64), start
    at = np.flatnonzero(inside)
    before = np.searchsorted(at, start)  # word bytes before each word
    length = np.diff(np.append(before, len(at)))
    place = np.arange(len(at)) - np.repeat(before, length)
    value = (_LOWER[data[at]] + np.uint64(1)) * _POWERS[place & 4095]
    return _scramble(np.add.reduceat(value, before) + length.astype(np.uint64)), start


_PART = 1 << 20    # bytes hashed at once
_HELD = 1 << 21    # keys counted at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def batch_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of the words of a batch in order, the row of each, and how many of the
    first ones were given before.

    About ``_PART`` bytes at a time: several texts, or a part of a long one, which
    is cut at white space and begins with the word before the cut.
    """
    held: list[bytes] = []
    rows: list[int] = []

    def flush() -> tuple[np.ndarray, np.ndarray, int]:
        ends = np.cumsum([len(b) + 1 for b in held])
        words, start = word_hashes(np.frombuffer(b"\n".join(held) + b"\n", np.uint8))
        row = np.array(rows)[np.searchsorted(ends, start, side="right")]
        held.clear()
        rows.clear()
        return words, row, 0

    size = 0
    for i, value in enumerate(texts.cast(pa.binary())):
        data = value.as_py() or b""
        if len(data) <= _PART:
            held.append(data)
            rows.append(i)
            size += len(data)
            if size < _PART:
                continue
        if held:
            yield flush()
            size = 0
        if len(data) > _PART:
            at, last = 0, np.zeros(0, np.uint64)
            while at < len(data):
                cut = _SPACE.search(data, at + _PART)
                end = cut.start() if cut else len(data)
                words = np.concatenate([last, word_hashes(np.frombuffer(data, np.uint8, end - at, at))[0]])
                yield words, np.full(len(words), i), len(last)
                at, last = end, words[-1:]
    if held:
        yield flush()


def _grams(words: np.ndarray, row: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's predecessor in its row (0: none), the word and its row."""
    before = np.zeros_like(words)
    same = np.flatnonzero(row[1:] == row[:-1])
    before[same + 1] = words[same]
    return before[skip:], words[skip:], row[skip:]


def _key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return h ^ ((w << np.uint64(31)) | (w >> np.uint64(33)))


def _key_column() -> Column:
    w = F.col("w")
    return F.col("h").bitwiseXOR(F.shiftleft(w, 31).bitwiseOR(F.shiftrightunsigned(w, 33)))


def _counts(grams: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts of (first word, second word, target) parts, combined over about ``_HELD`` bigrams."""
    held, n = [], 0
    for part in grams:
        held.append(part)
        n += len(part[0])
        if n >= _HELD:
            yield _counted(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _counted(*map(np.concatenate, zip(*held)))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _counted(h: np.ndarray, w: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """Distinct bigrams with their counts in target and in background rows."""
    order = np.argsort(_key(h, w))
    h, w, target = h[order], w[order], target[order]
    first = _starts(h, w)
    n = np.diff(np.append(first, len(h)))
    t = np.add.reduceat(target.astype(np.int64), first)
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "w", "t", "b"])


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(h, w, t, b) parts of the bigrams of (text, target) rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                target = batch.column(1).to_numpy(zero_copy_only=False)
                for part in batch_words(batch.column(0)):
                    h, w, row = _grams(*part)
                    yield h, w, target[row]

        yield from _counts(grams())

    return rows.mapInArrow(count, _COUNTS)


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, its length if absent."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, len(table))


def _pairs(at: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words with a word before them in their row, and the pair's key (-1 unless both are in the vocabulary)."""
    second = 1 + np.flatnonzero(row[1:] == row[:-1]) if len(at) else np.zeros(0, np.int64)
    h, w = at[second - 1], at[second]
    return second, np.where((h < size) & (w < size), h * size + w, -1)


@dataclass
class PairModel:
    """The model of a vocabulary that fits in memory, as the formula reads.

    Row 0 of each table is the target model, row 1 the background model."""

    words: np.ndarray   # sorted hashes of the vocabulary
    chance: np.ndarray  # (2, words + 1): p(w); the last is the unknown word
    rest: np.ndarray    # (2, words + 1): 1 - k s(h)
    pairs: np.ndarray   # sorted keys: index of h times the vocabulary's size, plus index of w
    bonus: np.ndarray   # (2, pairs + 1): k c(h, w) / c(h); the last is 0

    def losses(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(2, words): minus the log chance of each word after the one before it in its row."""
        at = _find(self.words, words)
        chance = self.chance[:, at]
        second, key = _pairs(at, row, len(self.words))
        chance[:, second] = self.rest[:, at[second - 1]] * chance[:, second] + self.bonus[:, _find(self.pairs, key)]
        return -np.log(chance)


def build(words: np.ndarray, counts: np.ndarray, tokens: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, mix: float) -> PairModel:
    size = len(words)
    unknown = np.maximum(tokens[:, None] - counts.sum(axis=1, keepdims=True), 0)
    all_counts = np.hstack([counts, unknown])
    chance = (all_counts + 1) / (all_counts.sum(axis=1, keepdims=True) + size + 1)
    history = pairs // max(size, 1)
    share = pair_counts / np.maximum(counts[:, history], 1)
    kept = np.stack([np.bincount(history, s, size + 1) for s in share])
    return PairModel(words, chance, 1 - mix * kept, pairs, np.hstack([mix * share, np.zeros((2, 1))]))


@dataclass
class CountModel:
    pairs: DataFrame     # h, w, t, b: every bigram's counts in target and background rows; h is 0 before a text's first word
    words: DataFrame     # w, t, b, kept_t, kept_b: the vocabulary, and how often a bigram of it follows
    tokens: np.ndarray   # (2,): of target and background
    unknown: np.ndarray  # (2,): of them outside the vocabulary
    size: int            # of the vocabulary
    pair_least: float
    mix: float

    def losses(self, pairs: DataFrame) -> DataFrame:
        """(key, c, t, b): the count of each bigram of ``pairs`` and its loss under both models."""
        word = self.words.select("w", F.col("t").alias("wt"), F.col("b").alias("wb"))
        first = self.words.select(F.col("w").alias("hk"), F.col("t").alias("ht"), F.col("b").alias("hb"), "kept_t", "kept_b")
        # the starts of texts, which have no first word, are dealt by their second
        rows = pairs.withColumn("hk", F.when(F.col("h") == 0, F.col("w")).otherwise(F.col("h")))
        rows = rows.join(word, "w", "left").join(first, "hk", "left")
        known = (F.col("h") != 0) & F.col("ht").isNotNull()
        kept = known & F.col("wt").isNotNull() & (F.col("t") + F.col("b") >= self.pair_least)

        def loss(m: str, i: int) -> Column:
            chance = (F.coalesce(F.col(f"w{m}").cast("double"), F.lit(float(self.unknown[i]))) + 1) / (float(self.tokens[i]) + self.size + 1)
            n = F.greatest(F.col(f"h{m}"), F.lit(1))
            after = (1 - self.mix * F.col(f"kept_{m}") / n) * chance + F.when(kept, self.mix * F.col(m) / n).otherwise(0.0)
            return -F.log(F.when(known, after).otherwise(chance))

        return rows.select(_key_column().alias("key"), (F.col("t") + F.col("b")).alias("c"), loss("t", 0).alias("t"), loss("b", 1).alias("b"))


def fit(docs: DataFrame, target_col: str, text_col: str = "text", word_share: float = 0.0, pair_share: float = 0.0, mix: float = 0.6) -> CountModel:
    """Both models from ``docs``, counted over all rows."""
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("target"))
    pairs = written(_summed(_pair_counts(rows), "h", "w"), "lm-pairs")
    counted = written(_summed(pairs, "w"), "lm-words")
    tokens = np.array([int(x or 0) for x in counted.agg(F.sum("t"), F.sum("b")).first()], np.float64)
    word_least, pair_least = (max(1.0, share * float(tokens.sum())) for share in (word_share, pair_share))
    words = counted.where(F.col("t") + F.col("b") >= word_least)
    size, *inside = words.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    kept = pairs.where((F.col("h") != 0) & (F.col("t") + F.col("b") >= pair_least))
    if word_least > 1:
        kept = kept.join(words.select("w"), "w", "left_semi")
    kept = _summed(kept, "h").select(F.col("h").alias("w"), F.col("t").alias("kept_t"), F.col("b").alias("kept_b"))
    words = written(words.join(kept, "w", "left").fillna(0, ["kept_t", "kept_b"]), "lm-vocabulary")
    return CountModel(pairs, words, tokens, tokens - np.array(inside, np.float64), size, pair_least, mix)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written with a number for each row, by which its losses find it."""
    return written(df.withColumn("__uid", F.monotonically_increasing_id()), "lm-rows")


def score(df: DataFrame, model: CountModel, text_col: str = "text", fitted: bool = False, hot_share: float = 2e-6) -> DataFrame:
    """Add ``n_tokens``, ``loss_target``, ``loss_background`` (per token) and ``score``, their difference.

    ``fitted``: the model was fitted on these rows, so it has all their bigrams.  Rows from :func:`numbered` are not written again.
    """
    df = df if "__uid" in df.columns else numbered(df)
    pairs = model.pairs
    if not fitted:
        new = _pair_counts(df.select(F.col(text_col).alias("text"), F.lit(False).alias("target")))
        pairs = _summed(pairs.union(new.select("h", "w", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("b"))), "h", "w")
    losses = written(model.losses(pairs), "lm-losses")
    common = F.col("c") >= max(2.0, hot_share * float(model.tokens.sum()))
    hot = losses.where(common).select("key", "t", "b").toArrow()
    keys = hot.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = df.sparkSession.sparkContext.broadcast((keys[order], np.stack([np.append(hot.column(m).to_numpy()[order], 0.0) for m in ("t", "b")])))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the common bigrams of a text, already summed, and one for each other bigram."""
        known, loss = shared.value
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for part in batch_words(batch.column(1)):
                h, w, row = _grams(*part)
                key = _key(h, w)
                at = _find(known, key)
                own, rare = row[at < len(known)], at == len(known)
                n = np.bincount(own, minlength=len(batch))
                total = [np.bincount(own, x[at[~rare]], len(batch)) for x in loss]
                some = np.flatnonzero(n)
                # sums need no partner: their key only spreads them
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[some]), pa.array(_scramble(uid[some].astype(np.uint64)).view(np.int64)), pa.array(n[some]), *(pa.array(x[some].astype(np.float64)) for x in total)],
                    ["__uid", "key", "n", "t", "b"])
                key, row = key[rare], row[rare]
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                first = _starts(key, row)
                none = pa.nulls(len(first), pa.float64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[row[first]]), pa.array(key[first].view(np.int64)), pa.array(np.diff(np.append(first, len(key)))), none, none],
                    ["__uid", "key", "n", "t", "b"])

    rare = losses.where(~common).select("key", F.col("t").alias("lt"), F.col("b").alias("lb"))
    met = df.select("__uid", F.col(text_col)).mapInArrow(grams, _GRAMS).join(rare, "key", "left")
    lost = F.raise_error(F.lit("a bigram of a text is not in the model: were these the fitted rows?")).cast("double")
    per_text = met.groupBy("__uid").agg(
        F.sum("n").alias("__n"), *[F.sum(F.coalesce(m, F.col("n") * F.col(f"l{m}"), lost)).alias(f"__{m}") for m in ("t", "b")])
    mean = lambda m: F.col(f"__{m}") / F.col("__n")
    return df.join(per_text, "__uid", "left").withColumns({
        "n_tokens": F.coalesce("__n", F.lit(0).cast("long")), "loss_target": mean("t"), "loss_background": mean("b"), "score": mean("t") - mean("b"),
    }).drop("__uid", "__n", "__t", "__b")


# -- a corpus scored by the models of itself ------------------------------------

_ENTRY = np.dtype([("h", "<u8"), ("w", "<u8"), ("text", "<u4"), ("n", "<u4")])
_TEXT = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("n", "<i8")])
_BUCKET = 1 << 21   # bigrams that a task scores at once
_CHUNK = 1 << 20    # bigrams packed at once
_COMMON = 1 << 20   # a first word of more bigrams is dealt by the second


def _runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and the run of each row."""
    first = _starts(*sorted_keys)
    return first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sorted_keys[0]))))


def _history_counts(rows: DataFrame) -> DataFrame:
    """(w, t, b): each word of the vocabulary (and 0, the start of a text) and how often
    bigrams begin with it in target and background rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, t, b = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(key)
            key = key[order]
            first = _starts(key)
            return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *(pa.array(np.add.reduceat(x[order], first)) for x in (t, b))], ["w", "t", "b"])

        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in batch_words(batch.column(0)):
                h, w, row = _grams(*part)
                if len(w):
                    own, none = target[row], np.zeros(len(w), np.int64)
                    held.append((np.concatenate([h, w]), np.concatenate([own, none]), np.concatenate([1 - own, none])))
                    size += len(w)
                    if size >= _HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return _summed(rows.mapInArrow(count, "w long, t long, b long"), "w")


def _split(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as parts of 255 at most: how many parts each has, and the parts."""
    times = (n + 254) // 255
    parts = np.full(times.sum(), 255, np.int64)
    parts[np.cumsum(times) - 1] = n - 255 * (times - 1)
    return times, parts


def _pack(rows: np.ndarray) -> bytes:
    """Entries sorted by first word: a first word (56 bits) and how many entries follow, 48
    bits of a second word (they only tell apart the words after one first word), the text,
    and a count; counts are of 255 at most."""
    first = _starts(rows["h"])
    times, after = _split(np.diff(np.append(first, len(rows))))
    wide = np.uint16 if rows["text"].max(initial=0) < 1 << 16 else np.uint32
    high = lambda x, n: x.copy().view(np.uint8).reshape(-1, 8)[:, 8 - n :]
    head = np.array([len(rows), len(after), np.dtype(wide).itemsize], np.uint32)
    return b"".join(x.tobytes() for x in (
        head, high(np.repeat(rows["h"][first], times), 7), after.astype(np.uint8), high(rows["w"], 6), rows["text"].astype(wide), rows["n"].astype(np.uint8)))


def _unpack(data: bytes) -> np.ndarray:
    n, n_first, wide = np.frombuffer(data, np.uint32, 3).tolist()
    at = 12

    def take(dtype: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype, count, at)
        at += out.nbytes
        return out

    def words(bytes_: int, count: int) -> np.ndarray:
        out = np.zeros((count, 8), np.uint8)
        out[:, 8 - bytes_ :] = take(np.uint8, bytes_ * count).reshape(-1, bytes_)
        return out.view(np.uint64).reshape(-1)

    rows = np.zeros(n, _ENTRY)
    first = words(7, n_first)
    rows["h"] = np.repeat(first, take(np.uint8, n_first))
    rows["w"] = words(6, n)
    rows["text"] = take(np.uint16 if wide == 2 else np.uint32, n)
    rows["n"] = take(np.uint8, n)
    return rows


def _pack_sums(text: np.ndarray, *losses: np.ndarray) -> bytes:
    """Losses of texts of a chunk, by their numbers there."""
    wide = np.uint16 if text.max(initial=0) < 1 << 16 else np.uint32
    return b"".join(x.tobytes() for x in (np.array([len(text), np.dtype(wide).itemsize], np.uint32), text.astype(wide), *losses))


def _unpack_sums(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(data, np.uint32, 2).tolist()
    at = 8 + n * wide
    return np.frombuffer(data, np.uint16 if wide == 2 else np.uint32, n, 8), np.frombuffer(data, np.float64, n, at), np.frombuffer(data, np.float64, n, at + 8 * n)


def _entries(rows: DataFrame, buckets: int, common: Broadcast) -> DataFrame:
    """(bucket, chunk, mark, texts, entries): distinct bigrams of the texts of a chunk, packed.
    All bigrams with the same first word go to one bucket, but for the common first words,
    which the second deals.  A chunk's texts are numbered; their keys and tokens are one row of
    their own.  A chunk is known by its place and by a hash of its texts."""
    names = ["bucket", "chunk", "mark", "texts", "entries"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value[0]
        held: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        size = n_texts = 0
        chunk = TaskContext.get().partitionId() << 32

        def row(bucket: int, mark: int, texts_: bytes | None, entries: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([mark], pa.int64()), pa.array([texts_], pa.binary()), pa.array([entries], pa.binary())], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            rows_, keys = np.concatenate(held), np.concatenate(texts)
            held.clear()
            texts.clear()
            first, of = _runs(rows_["text"])  # in order
            keys = keys[rows_["text"][first]]
            own = np.zeros(len(keys), _TEXT)
            own["k1"], own["k2"], own["n"] = keys["k1"], keys["k2"], np.diff(np.append(first, len(rows_)))
            data = own.tobytes()
            mark = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
            yield row(mark % buckets, mark, data, None)
            rows_["text"] = 2 * of + keys["target"][of]  # the lowest bit: of a target
            del first, of
            by_first = _scramble(rows_["h"])
            by_both = _scramble(_key(rows_["h"], rows_["w"]))
            bucket = np.where(_find(known, rows_["h"]) < len(known), by_both, by_first) % np.uint64(buckets)
            order = np.lexsort((rows_["text"], rows_["w"], rows_["h"], bucket))
            rows_, bucket = rows_[order], bucket[order]
            del order, by_first, by_both
            first = _starts(bucket, rows_["h"], rows_["w"], rows_["text"])
            merged, bucket = rows_[first], bucket[first]
            n = np.diff(np.append(first, len(rows_)))
            del rows_
            times, n = _split(n)
            merged, bucket = np.repeat(merged, times), np.repeat(bucket, times)
            merged["n"] = n
            cuts = _starts(bucket)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket))):
                yield row(int(bucket[lo]), mark, None, _pack(merged[lo:hi]))
            chunk += 1

        for batch in batches:
            keys = np.zeros(len(batch), [("k1", "<i8"), ("k2", "<i8"), ("target", "?")])
            keys["k1"], keys["k2"], keys["target"] = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            texts.append(keys)
            for part in batch_words(batch.column(2)):
                h, w, at = _grams(*part)
                new = np.zeros(len(w), _ENTRY)
                new["h"], new["w"], new["text"] = h, w, n_texts + at
                held.append(new)
                size += len(w)
                if size >= _CHUNK:
                    yield from flush()
                    size, n_texts = 0, 0
                    texts.append(keys)
            n_texts += len(keys)
            if not size:
                held.clear()
                texts.clear()
                n_texts = 0
        if size:
            yield from flush()

    return rows.mapInArrow(pack, "bucket int, chunk long, mark long, texts binary, entries binary")


def _scored(batches: Iterator[pa.RecordBatch], common: Broadcast, size: int, mix: float) -> Iterator[pa.RecordBatch]:
    """(chunk, mark, texts, sums): per chunk the losses that its texts have in a bucket; the
    rows are a bucket's, those with a chunk's texts pass."""
    known, counts = common.value
    known = known >> np.uint64(8) << np.uint64(8)  # first words come in 56 bits
    names = ["chunk", "mark", "texts", "sums"]

    def score(held: list[bytes]) -> list[bytes]:
        parts, owns = [], []
        begin = 0
        while held:
            part = _unpack(held.pop())
            own, place = np.unique(part["text"], return_inverse=True)
            part["text"] = begin + place.reshape(-1)
            begin += len(own)
            parts.append(part)
            owns.append(own)
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.lexsort((rows["w"], rows["h"]))]
        first, of = _runs(rows["h"])
        pair, of_pair = _runs(rows["h"], rows["w"])
        at = _find(known, rows["h"][first])
        n, text = rows["n"].astype(np.int64), rows["text"]
        del rows
        target = (np.concatenate(owns) & 1).astype(bool)[text]
        sums = []
        for i, mine in enumerate((target, ~target)):
            c = n * mine
            after = np.where(at < len(known), np.append(counts[i], 0)[at], np.add.reduceat(c, first))[of]
            chance = np.where(after > 0, mix * np.add.reduceat(c, pair)[of_pair] / np.maximum(after, 1) + (1 - mix) / size, 1 / size)
            sums.append(np.bincount(text, n * -np.log(chance), begin))
        ends = np.cumsum([len(own) for own in owns])
        return [_pack_sums(own >> 1, *(x[end - len(own) : end] for x in sums)) for own, end in zip(owns, ends)][::-1]

    chunks: list[tuple[int, int]] = []
    held: list[bytes] = []
    for batch in batches:
        for chunk, mark, texts, entries in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if entries is None:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([mark], pa.int64()), pa.array([texts], pa.binary()), pa.nulls(1, pa.binary())], names)
            else:
                chunks.append((chunk, mark))
                held.append(entries)
    if held:
        for (chunk, mark), sums in zip(chunks, score(held)):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([mark], pa.int64()), pa.nulls(1, pa.binary()), pa.array([sums], pa.binary())], names)


def _chunk_losses(rows: pa.Table) -> pa.Table:
    """(k1, k2, n, t, b) of the texts of a chunk, from its texts and their losses in the buckets."""
    texts = rows["texts"].drop_null().to_pylist()
    if len(texts) != 1:
        raise RuntimeError("A task that ran again gave other texts: the rows to score must be a scan or a written table.")
    own = np.frombuffer(texts[0], _TEXT)
    t, b = np.zeros(len(own)), np.zeros(len(own))
    for data in rows["sums"].drop_null():
        at, *losses = _unpack_sums(data.as_py())
        t[at] += losses[0]
        b[at] += losses[1]
    return pa.table({"k1": own["k1"].copy(), "k2": own["k2"].copy(), "n": own["n"].copy(), "t": t, "b": b})


def score_corpus(df: DataFrame, target_col: str, text_col: str = "text", mix: float = 0.6, least_buckets: int = 16) -> DataFrame:
    """Add ``n_tokens``, ``loss_target``, ``loss_background`` and ``score`` as :func:`score`
    does, under models of these rows themselves: counting and scoring in one exchange.

    p(w | h) = k c(h, w) / c(h) + (1 - k) / v: the models back off to the shared
    vocabulary of v words (one more for the unknown), so a bigram's loss needs only what
    lies under its first word.  A first pass counts the first words; then the distinct
    bigrams of the texts, packed, are dealt by first word into buckets of some two million,
    where all counts and losses follow from sorted rows.  First words of over a million
    bigrams (and a millionth of all) are dealt by second word, their c(h) broadcast.  Texts
    are numbered within chunks of a million bigrams: a bucket gives, for each chunk, numbers
    and losses, which meet the chunk's texts in a second exchange.  Texts are known by a
    128-bit hash, so none is written or shuffled and equal texts share their losses.  ``df``
    must give the same rows when a task runs again (a scan, a written table): a chunk whose
    texts changed fails the job.
    """
    target = F.coalesce(F.col(target_col), F.lit(False))
    keys = {"__t1": F.xxhash64(F.lit(1), F.coalesce(F.col(text_col), F.lit(""))), "__t2": F.xxhash64(F.lit(2), F.coalesce(F.col(text_col), F.lit("")))}
    words = _history_counts(df.select(F.col(text_col).alias("text"), target.alias("target")))
    n = F.col("t") + F.col("b")
    # one pass: the least count of a common word follows from the bytes of the texts, which bound their words
    most = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0] // 2 + 1
    size, total, hot = words.agg(F.count_if(F.col("w") != 0) + 1, F.coalesce(F.sum(n), F.lit(0)),
                                 F.collect_list(F.when(n > max(_COMMON, most // 1_000_000), F.struct("w", "t", "b")))).first()  # at most a million words
    hot = np.array([tuple(x) for x in hot], np.int64).reshape(-1, 3)
    hot = hot[np.argsort(hot[:, 0].view(np.uint64))] if len(hot) else hot
    common = df.sparkSession.sparkContext.broadcast((hot[:, 0].copy().view(np.uint64), [hot[:, 1].copy(), hot[:, 2].copy()]))
    buckets = max(least_buckets, -(-total // _BUCKET))
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).alias("text"), target.alias("target"))
    dealt = _entries(rows, buckets, common).repartitionById(buckets, "bucket")  # a bucket a task
    sums = dealt.mapInArrow(lambda b: _scored(b, common, size, mix), "chunk long, mark long, texts binary, sums binary")
    sums = sums.groupBy("chunk", "mark").applyInArrow(_chunk_losses, "k1 long, k2 long, n long, t double, b double")
    sums = sums.groupBy(F.col("k1").alias("__t1"), F.col("k2").alias("__t2")).agg(*[F.sum(c).alias(f"__{c}") for c in "ntb"])
    # equal texts were summed up together: each has its share of the tokens
    slim = df.withColumns(keys).drop(text_col)
    copies = slim.groupBy("__t1", "__t2").agg(F.count(F.lit(1)).alias("__copies"))
    per_text = written(copies.join(sums, ["__t1", "__t2"]), "lm-sums")
    mean = lambda m: F.col(f"__{m}") / F.col("__n")
    return skew_split_join(slim, per_text, ["__t1", "__t2"], ["__t1", "__t2"]).withColumns({
        "n_tokens": F.coalesce((F.col("__n") / F.col("__copies")).cast("long"), F.lit(0).cast("long")), "loss_target": mean("t"), "loss_background": mean("b"),
        "score": mean("t") - mean("b")}).drop("__t1", "__t2", "__n", "__t", "__b", "__copies")
