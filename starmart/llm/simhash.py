"""SimHash near-dedup with a bit-sliced comparison.

Fingerprints: ASCII upper-case letters are lower-cased, words are runs without
ASCII white space, shingles are ``shingle`` consecutive words joined by a space
(a shorter text is one shingle), every shingle is hashed by XXH64 with seed 42,
and a bit is set if it is set in more than half of the hashes.

Links: fingerprints that differ in at most ``radius`` bits.  64 bits are cut into
``bands`` bands; ``radius`` differing bits leave at least ``bands - radius`` bands
equal, so two linked fingerprints share the value of some set of that many bands.
Each such set is one table of buckets, which makes the candidate search exact.
Within buckets fingerprints are stored as vertical bit planes, 64 to a word.  A
row adds the planes' differences into bit-sliced counters by carry-save adders,
64 distances at a time, and (row, word) pairs whose distances all exceed the
radius are abandoned.  Equal fingerprints are one row before any comparison, and
a bucket beyond ``block`` rows is compared as pairs of blocks by many tasks.

Only a spanning forest of the links found by a task leaves it; connected
components join the forests.

Defined results: a null text, an empty one and one of white space have
fingerprint zero, which links like any other; null ids count as larger than all
others, and a group of null ids only has a null component; repeated rows link
and one of them is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from starmart.llm.common import connected_components, written

SEED = 42
_PART = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, shingle: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest, n, count = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _PART], ends[at : at + _PART])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """Add ``out_col``: the 64-bit fingerprint as a (signed) long."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = np.array([fingerprint(v.as_buffer().to_pybytes() if v.is_valid else None, shingle) for v in batch], np.uint64)
            yield pa.array(prints.view(np.int64))
    return df.withColumn(out_col, F.arrow_udf(run, LongType())(F.col(text_col).cast("binary")))


def hex16(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


# ------------------------------------------------------------------ comparison
def _planes(prints: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane[b, w] is bit b of print 64 w + i."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _low(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits set, 0 <= n <= 64."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))


def close_lanes(planes: np.ndarray, rows: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted ``lanes`` of ``words`` lie within ``radius`` of ``rows`` (64-bit values).

    Returns the indices of pairs with such lanes, and the lanes as bits.
    """
    n_counters = max(1, radius.bit_length())  # counters run to 2**n_counters - 1 >= radius
    live = np.flatnonzero(lanes)
    rows, words, lanes = rows[live], words[live], lanes[live]
    counters = [np.zeros(len(live), np.uint64) for _ in range(n_counters)]

    def differs(b: int) -> np.ndarray:
        return planes[b, words] ^ (np.uint64(0) - ((rows >> np.uint64(b)) & np.uint64(1)))

    def add(carry: np.ndarray, level: int) -> None:
        for k in range(level, n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        np.bitwise_and(lanes, ~carry, out=lanes)  # beyond what the counters hold

    for b in range(0, 64, 8):
        for k in range(b, b + 8, 2):
            # carry-save: two difference planes and the ones counter give ones and a carry of twos
            x, y, c = differs(k), differs(k + 1), counters[0]
            xy = x ^ y
            counters[0] = xy ^ c
            add((x & y) | (xy & c), 1)
        over = _above(counters, radius)
        lanes &= ~over
        if not lanes.all():
            keep = np.flatnonzero(lanes)
            live, rows, words, lanes = live[keep], rows[keep], words[keep], lanes[keep]
            counters = [c[keep] for c in counters]
            if not len(keep):
                break
    return live, lanes


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds radius: a bitwise comparison from the top bit down."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def forest(prints: np.ndarray, first: np.ndarray, stop: np.ndarray, radius: int, chunk: int = 1 << 15) -> np.ndarray:
    """Label each row by the smallest row that links lead to.

    Row i is compared with the rows first[i] .. stop[i] - 1.
    """
    label = np.arange(len(prints))
    planes = _planes(prints)
    todo = np.flatnonzero(stop > first)
    spans = (stop[todo] - 1) // 64 - first[todo] // 64 + 1
    ends = np.cumsum(spans)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, chunk):
        pair = np.arange(at, min(total, at + chunk))
        which = np.searchsorted(ends, pair, side="right")
        row = todo[which]
        word = first[row] // 64 + pair - (ends[which] - spans[which])
        lanes = _low(np.clip(stop[row] - word * 64, 0, 64)) & ~_low(np.clip(first[row] - word * 64, 0, 64))
        live, found = close_lanes(planes, prints[row], word, lanes, radius)
        if len(live):
            bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(bits)
            _union(label, row[live[k]], word[live[k]] * 64 + lane)
    return _roots(label)


def _roots(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := label[label], label):
        label = up
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hang the larger root of each pair below the smaller until all pairs agree."""
    while True:
        label[:] = _roots(label)
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])


def _unit_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (__unit hash parts, side, fp) sorted by unit and side, to forest edges (a, b)."""
    held: list[pa.Table] = []

    def links(t: pa.Table) -> pa.RecordBatch:
        key, i, j, side, fp = (t.column(c).to_numpy() for c in ("__key", "__i", "__j", "__side", "__fp"))
        n = len(key)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        size = np.diff(np.concatenate((new, [n])))
        end = np.repeat(new + size, size)
        other = np.repeat(new + np.add.reduceat((side == 0).astype(np.int64), new), size)  # first row of side 1
        at = np.arange(n)
        first = np.where(i == j, at + 1, np.where(side == 0, other, end))
        root = forest(fp.view(np.uint64), first, end, radius)
        moved = np.flatnonzero(root != at)
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < 1 << 18:
            continue
        t = pa.concat_tables(held).combine_chunks()
        last = [t.column(c)[-1].as_py() for c in ("__key", "__i", "__j")]
        tail = np.ones(len(t), bool)
        for c, v in zip(("__key", "__i", "__j"), last):
            tail &= t.column(c).to_numpy() == v
        cut = len(t) - int(tail.sum())
        if cut:
            yield links(t.slice(0, cut).combine_chunks())
        held, rows = [t.slice(cut)], len(t) - cut  # the last unit may go on in the next batch
    if rows:
        yield links(pa.concat_tables(held).combine_chunks())


def fingerprint_links(prints: DataFrame, radius: int, bands: int, block: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct ``__fp`` of ``prints``."""
    if bands <= radius:
        raise ValueError("bands must exceed radius")
    edges = [64 * k // bands for k in range(bands + 1)]
    values = [F.shiftrightunsigned("__fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    keys = F.array(*[F.xxhash64(F.lit(t), *[values[k] for k in ks]) for t, ks in enumerate(combinations(range(bands), bands - radius))])
    rows = prints.select("__fp", F.explode(keys).alias("__key"))
    # buckets beyond one block, from counts that combine before the shuffle; all others are one unit
    large = rows.groupBy("__key").count().where(F.col("count") > block).select("__key", F.ceil(F.col("count") / block).cast("int").alias("__blocks"))
    own = F.pmod(F.xxhash64(F.lit(1), "__fp"), F.coalesce("__blocks", F.lit(1))).cast("int")
    units = (
        rows.join(large, "__key", "left")
        .withColumn("__own", own)
        .withColumn("__with", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1)))
        .select(
            "__key",
            F.least("__own", "__with").cast("int").alias("__i"),
            F.greatest("__own", "__with").cast("int").alias("__j"),
            (F.col("__own") > F.col("__with")).cast("int").alias("__side"),
            "__fp",
        )
    )
    return (
        units.repartition("__key", "__i", "__j").sortWithinPartitions("__key", "__i", "__j", "__side", "__fp")
        .mapInArrow(lambda b: _unit_links(b, radius), "a long, b long")
    )


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", radius: int = 4,
                          bands: int = 6, block: int = 8192) -> DataFrame:
    """Add ``component_id`` (smallest id of the group) and ``kept`` (true for one row of each group).

    ``df`` carries the fingerprint column of :func:`with_fingerprints`; it is
    written once with a row number, so every later job sees the same rows.
    """
    rows = written(df.drop("component_id", "kept").withColumn("__row", F.monotonically_increasing_id()), "simhash")
    lead = F.min(F.struct(F.col(id_col).isNull().alias("__null"), F.col(id_col).alias("__id"), F.col("__row").alias("__row")))
    prints = written(rows.groupBy(F.col(fp_col).alias("__fp")).agg(lead.alias("__lead")), "simhash-prints")
    comps = connected_components(fingerprint_links(prints.select("__fp"), radius, bands, block))
    grouped = prints.join(comps, prints["__fp"] == comps["node"], "left").select("__fp", "__lead", F.coalesce("component", "__fp").alias("__comp"))
    leads = grouped.groupBy("__comp").agg(F.min("__lead").alias("__first"))
    of_print = grouped.join(leads, "__comp").select(
        "__fp", F.col("__first.__id").alias("component_id"), F.col("__first.__row").alias("__first"))
    return (
        rows.join(of_print, rows[fp_col] == of_print["__fp"])
        .withColumn("kept", F.col("__row") == F.col("__first"))
        .drop("__fp", "__row", "__first")
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``df`` less all but the first (smallest id) of each near-duplicate group."""
    marked = near_duplicate_groups(with_fingerprints(df, text_col, "__print", shingle), id_col, "__print", radius)
    return marked.where("kept").select(*[F.col(f"`{c}`") for c in df.columns])
