"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes a vector of hashed byte n-grams (orders 1 to 3 over its letters,
lower-cased, words set apart by one space), weighted by log term frequency times
inverse document frequency and scaled to unit length.  Every language has
several centroids, found by spherical k-means, and a text takes the language of
the centroid with the largest cosine.  A text whose cosine is below the limit of
that centroid and of its own length band (powers of two of its n-grams) is rejected.

Fitting: document frequencies count all learning rows; the k-means seeds come
from a bounded sample (``sample`` rows a language, those with the smallest text
hash), and one pass over all learning rows then moves each centroid to the mean
of the rows nearest to it.  A centroid with less than a ``support`` of its language's rows,
or a single one, is left out: a mislabelled row makes no centroid.  A last pass
over all learning rows counts the cosines with the final centroids in
bins: of each text, and of short pieces of it (in two of the shorter bands, drawn by the
text's checksum; the middle one of three pieces counts), so short texts have limits
though few rows are short.  A limit is ``margin`` of the ``quantile`` of its centroid and
band, at least the second smallest of 20 or more; below 100 cosines it is that of the band over all
centroids, and an empty band takes the limit of the next shorter one.  So single odd rows do not move
a limit, and more rows only make it more precise.  Short texts of a foreign language in
a known script can come near known ones, and some of them pass.

The model holds the centroids (languages x clusters x buckets), their limits and one
weight per bucket: it does not grow with the rows.

Defined results: null texts and texts without a letter are ``und`` with score 0
and are rejected; so is every text if there was nothing to learn from.  Equal
cosines go to the language first by code point.  Null languages are not learned
from.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_GRAMS = (1, 2, 3)
_PART = 1 << 20  # bytes whose n-grams are hashed at once
_BANDS = 10      # length bands: the last has 2**9 n-grams and more
_SHORT = 10      # pieces of 1 to 2**9 characters
_BINS = 1000     # of cosines

# Byte classes: ASCII letters and all bytes of other characters stay, the rest is a space.
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class LanguageModel:
    languages: list[str]     # of each centroid
    centroids: np.ndarray    # (n, buckets), unit length
    limits: np.ndarray       # (n, bands): smallest cosine accepted
    idf: np.ndarray          # (buckets,)


def gram_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and how often, over the whole text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    total = np.zeros(buckets, np.int64)
    folded = _FOLD[raw]
    space = folded == 32
    folded = folded[~(space & np.concatenate(([False], space[:-1])))]
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(folded), _PART):
        part = folded[at : at + _PART + _GRAMS[-1] - 1].astype(np.uint32)
        own = min(_PART, len(folded) - at)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, _GRAMS[-1] + 1):
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :]
            if n in _GRAMS:
                hashed = ((code + np.uint32(n)) * np.uint32(2654435761)) >> shift
                total += np.bincount(hashed[:own], minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    at, n = gram_counts(text, len(idf))
    w = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(w @ w)
    return at, w / norm if norm else w, int(n.sum())


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def predict_text(text: str | None, m: LanguageModel) -> tuple[str, float, bool]:
    """(language, cosine, accepted)"""
    if not len(m.languages) or not has_letter(text):
        return UNDETERMINED, 0.0, False
    best, top, band = _nearest(text, m)
    return m.languages[best], min(1.0, max(0.0, top)), top > 0 and top >= float(m.limits[best, band])


def _nearest(text: str, m: LanguageModel) -> tuple[int, float, int]:
    """The nearest centroid, its cosine and the text's length band."""
    at, w, n = _vector(text, m.idf)
    cos = m.centroids[:, at] @ w
    best = int(np.argmax(cos))
    return best, float(cos[best]), min(n.bit_length() - 1, _BANDS - 1)


def _document_frequencies(rows: DataFrame, text_col: str, buckets: int) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(buckets, np.int64), 0
        for text, _ in _rows(batches):
            if has_letter(text):
                df[gram_counts(text, buckets)[0]] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], ["bucket", "n"])

    total = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, at = np.zeros(buckets, np.int64), total["bucket"].to_numpy()
    df[at[at >= 0]] = total["n"].to_numpy()[at >= 0]
    return df, int(total["n"].to_numpy()[at < 0].sum())


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Farthest-first seeds, then means of the nearest rows; rows of x have unit length."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        seeds.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 4096, clusters: int = 4,
        sample: int = 250, support: float = 0.002, quantile: float = 0.02, margin: float = 0.65) -> LanguageModel:
    """Learn from the rows with a language; ``rows`` should hold learning rows only."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df, docs = _document_frequencies(rows, "text", buckets)
    idf = np.log((1 + docs) / (1 + df)) + 1
    idf[df == 0] = 0.0

    # seeds: a bounded sample, so its keys (sample x languages rows) can be broadcast
    keyed = rows.withColumn("h", F.xxhash64("text"))
    smallest = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cut = keyed.select("lang", "h").withColumn("r", smallest).where(F.col("r") <= sample).select("lang", "h").distinct()
    chosen = keyed.join(F.broadcast(cut), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, h, *_vector(text, idf)[:2]) for lang, h, text in
                   zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text"))) if has_letter(text)]
            if out:
                langs, hs, at, w = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs), pa.array(hs), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                     pa.array([v.astype(np.float32) for v in w], pa.list_(pa.float32()))], ["lang", "h", "at", "w"])

    seeds = chosen.mapInArrow(to_vectors, "lang string, h long, at array<int>, w array<float>").toPandas()
    languages: list[str] = []
    parts = []
    for lang, group in sorted(seeds.groupby("lang"), key=lambda g: g[0].encode("utf-8")):
        group = group.sort_values("h")
        x = np.zeros((len(group), buckets))
        for i, (at, w) in enumerate(zip(group["at"], group["w"])):
            x[i, at] = w
        c = _spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), clusters)
        languages += [lang] * len(c)
        parts.append(c)
    if not parts:
        return LanguageModel([], np.zeros((0, buckets)), np.zeros((0, _BANDS)), idf)
    model = LanguageModel(languages, np.vstack(parts), np.zeros((len(languages), _BANDS)), idf)
    return _limited(rows, _refine(rows, model, support), quantile, margin)


def _nearest_of_language(text: str, lang: str, m: LanguageModel, of: dict[str, np.ndarray]):
    at, w, _ = _vector(text, m.idf)
    own = of[lang]
    cos = m.centroids[np.ix_(own, at)] @ w
    best = int(np.argmax(cos))
    return own[best], at, w


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[str, str]]:
    """(text, language) of each row; only a slice of a batch is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _refine(rows: DataFrame, m: LanguageModel, support: float) -> LanguageModel:
    """One pass over all learning rows: each centroid moves to the mean of the rows of its language nearest to
    it, and goes if they are too few."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = {x: np.flatnonzero(np.array(m.languages) == x) for x in set(m.languages)}
        sums, n = np.zeros_like(m.centroids), np.zeros(len(m.languages))
        for text, lang in _rows(batches):
            if lang in of and has_letter(text):
                k, at, w = _nearest_of_language(text, lang, m, of)
                sums[k, at] += w
                n[k] += 1
        k, at = np.nonzero(sums)
        kn = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([k, kn]).astype(np.int32)), pa.array(np.concatenate([at, np.full(len(kn), -1)]).astype(np.int32)),
            pa.array(np.concatenate([sums[k, at], n[kn]]))], ["k", "at", "w"])

    # a sum of rounded values does not depend on the order in which tasks arrive
    total = rows.mapInArrow(add, "k int, at int, w double").groupBy("k", "at").agg(
        F.sum(F.round(F.col("w") * 1e6).cast("long")).alias("sum")).toPandas()
    k, at, got = total["k"].to_numpy(), total["at"].to_numpy(), total["sum"].to_numpy() / 1e6
    sums, n = m.centroids * 1e-9, np.zeros(len(m.languages))
    cell = at >= 0
    sums[k[cell], at[cell]] += got[cell]
    n[k[~cell]] = got[~cell]
    centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    own = np.array(m.languages)
    rows_of, most = ({x: f(n[own == x]) for x in set(m.languages)} for f in (np.sum, np.max))
    stay = [j for j, x in enumerate(m.languages) if n[j] >= max(2, support * rows_of[x]) or n[j] == most[x]]
    return LanguageModel([m.languages[j] for j in stay], centroids[stay], m.limits[stay], m.idf)


def _pieces(text: str) -> Iterator[list[str]]:
    """Three pieces of the text in each of two of the lengths below its own."""
    lengths = [1 << b for b in range(_SHORT) if 2 << b < len(text)]
    draw = zlib.crc32(text.encode("utf-8", "replace"))
    for size in {lengths[draw % len(lengths)], lengths[draw // _SHORT % len(lengths)]} if lengths else ():
        yield [text[(len(text) - size) * j // 4 :][:size] for j in (1, 2, 3)]


def _limited(rows: DataFrame, m: LanguageModel, quantile: float, margin: float) -> LanguageModel:
    """Limits from the cosines of all learning rows with the centroids, counted in bins by centroid and length band."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n = np.zeros((len(m.languages), _BANDS, _BINS), np.int64)

        def add(near: tuple[int, float, int]) -> None:
            n[near[0], near[2], min(max(int(near[1] * _BINS), 0), _BINS - 1)] += 1

        for text, _ in _rows(batches):
            if has_letter(text):
                add(_nearest(text, m))
                for pieces in _pieces(text):
                    near = sorted((_nearest(p, m) for p in pieces if has_letter(p)), key=lambda x: x[1])
                    if near:
                        add(near[len(near) // 2])
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.ravel()[cell])], ["cell", "n"])

    total = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(m.languages), _BANDS, _BINS), np.int64)
    n.reshape(-1)[total["cell"].to_numpy()] = total["n"].to_numpy()

    def low(bins: np.ndarray) -> float:
        rows = int(bins.sum())
        below = max(int(quantile * rows), int(rows >= 20))
        return margin * int(np.searchsorted(np.cumsum(bins), below, side="right")) / _BINS

    band = [low(n[:, b].sum(axis=0)) if n[:, b].any() else None for b in range(_BANDS)]
    first = next((x for x in band if x is not None), 0.0)
    limits = np.zeros((len(m.languages), _BANDS))
    for b in range(_BANDS):
        band[b] = band[b] if band[b] is not None else band[b - 1] if b else first
        limits[:, b] = [low(x[b]) if x[b].sum() >= 100 else band[b] for x in n]
    return LanguageModel(m.languages, m.centroids, limits, m.idf)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` (string), ``score`` (cosine, 0 to 1) and ``accepted`` (boolean)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("ok", BooleanType())])

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lang, score, ok = zip(*(predict_text(v.as_py(), shared.value) for v in batch)) if len(batch) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["lang", "score", "ok"])

    return df.withColumn("__lid", predict(F.col(text_col))).withColumns(
        {"lang_pred": F.col("__lid.lang"), "score": F.col("__lid.score"), "accepted": F.col("__lid.ok")}).drop("__lid")

