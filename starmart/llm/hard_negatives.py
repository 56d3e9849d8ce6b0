"""Hard-negative mining by a secondary-sort shuffle.

An anchor's positives are its best-scoring other rows of the same label; each opens
a window of scores just below its own, and the first rows of other labels inside it
are that positive's hard negatives.  Scores are inner products.

All anchors (the stated query set) meet all rows in blocks, one matrix product per
pair of blocks.  Positives first: anchors meet the blocks of their own label.  Then
each anchor carries its windows to every block, and a block gives the pairs that can
be among the first of a window, which is exact because the first rows of a window are
among the first of their blocks.  Those pairs are packed into keys (anchor, descending
score, kind, id), whose bytes sort as the values do; repartitionAndSortWithinPartitions
brings each anchor's keys into one partition in that order, and an iterator reads them
as a stream: a positive opens its window, a negative counts in every open window that
holds it.  It keeps the open windows only, never an anchor's rows.

Rows are packed into blocks as a stream over sorted partitions.  A label above a
``hot_share`` of all rows (so at most 1 / hot_share labels, whose counts are broadcast)
is dealt in parts of one block, and its anchors visit every part.

Defined results: rows with a null id, a null label, a null vector or null or non-finite
components take no part; shorter vectors count as padded with zeros; equal scores go
to the smaller id; an anchor is no positive of itself, another row with its id may be,
and repeated anchor rows are anchors each; anchors without positives and positives
without negatives give no row; a positive with a negative score has an empty window;
scores are exact while a hundredfold sum stays below 2**53; an empty table gives an
empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm import vectors
from starmart.llm.common import written

_ROW = ("__l1", "__l2", "__uid", "__id", "__v")
_PAIRS = "__uid long, score double, id long"
_KEY = np.dtype([("anchor", ">u8"), ("uid", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])  # 33 bytes
_UNPACK = struct.Struct(">QQQBQ").unpack
_SIGN = 1 << 63
_ALL = (1 << 64) - 1
_POSITIVE, _NEGATIVE = 0, 1
_SLICE = 256  # anchors whose scores are held at once
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"


# -- keys whose bytes sort as their values ------------------------------------

def _ordered(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)


def _descending(score: np.ndarray) -> np.ndarray:
    bits = (score + 0.0).view(np.uint64)  # + 0.0: one zero
    return np.where(bits >= np.uint64(_SIGN), bits, ~bits ^ np.uint64(_SIGN))


def pack(anchor: np.ndarray, uid: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> bytes:
    """The keys of pairs, one after another."""
    keys = np.empty(len(ids), _KEY)
    keys["anchor"], keys["uid"], keys["score"], keys["kind"], keys["id"] = _ordered(anchor), _ordered(uid), _descending(score), kind, _ordered(ids)
    return keys.tobytes()


def unpack(key: bytes) -> tuple[int, int, float, int, int]:
    anchor, uid, score, kind, id_ = _UNPACK(key)
    bits = score if score >= _SIGN else ~(score ^ _SIGN) & _ALL
    signed = lambda x: x - _SIGN
    return signed(anchor), signed(uid), struct.unpack(">d", bits.to_bytes(8, "big"))[0], kind, signed(id_)


def windows(keys: Iterable[bytes], negatives: int, low: int) -> Iterator[tuple]:
    """Stream of sorted keys to (anchor, positive, rank, negative, positive score, negative score)."""
    anchor, open_ = None, []
    for key in keys:
        if key[:16] != anchor:
            anchor, open_ = key[:16], []
        id_, _, score, kind, other = unpack(key)
        if kind == _POSITIVE:
            open_.append([other, score, 0])
            continue
        for w in open_:
            if low * w[1] <= 100 * score <= 100 * w[1]:
                w[2] += 1
                yield id_, w[0], w[2], other, w[1], score
        # scores only fall from here: a window that is full or left behind stays so
        open_ = [w for w in open_ if w[2] < negatives and low * w[1] <= 100 * score]


# -- blocks -------------------------------------------------------------------

def _packed(rows: DataFrame, name: str, block: int, group: list[str], fields: list[str]) -> DataFrame:
    """Rows with equal ``group`` packed into arrays of at most ``block`` rows: they come
    sorted, and only the array being filled is held."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + f", {name} array<struct<{', '.join(f'{f}: {kinds[f]}' for f in fields)}>>"

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, at = 0, None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rows_ = pa.StructArray.from_arrays([table.column(f).combine_chunks() for f in fields], fields)
            return pa.RecordBatch.from_arrays(
                [*(table.column(g).combine_chunks().slice(0, 1) for g in group), pa.ListArray.from_arrays(pa.array([0, len(rows_)], pa.int32()), rows_)], [*group, name])

        for batch in batches:
            keys = [batch.column(g).to_numpy() for g in group]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if len(batch) > 1 else np.zeros(0, int)
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                here = tuple(k[lo] for k in keys) if len(batch) else None
                while lo < hi:
                    if held and (here != at or size >= block):
                        yield flush()
                        held, size = [], 0
                    take = min(hi - lo, block - size)
                    held.append(batch.slice(lo, take))
                    at, lo, size = here, lo + take, size + take
        if held:
            yield flush()

    return rows.repartition(*group).sortWithinPartitions(*group).select(*group, *[f for f in fields if f not in group]).mapInArrow(pack_rows, schema)


def _arrays(rows: pa.StructArray, dim: int) -> dict[str, np.ndarray]:
    """The columns of a block."""
    return {f.name: vectors.matrix(rows.field(f.name), dim) if f.name == "__v" else rows.field(f.name).to_numpy(zero_copy_only=False)
            for f in rows.type if not f.name.startswith("__p_")}


def _block_pairs(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[dict, dict, pa.StructArray]]:
    for batch in batches:
        for i in range(len(batch)):
            anchors = batch.column("__anchors")[i].values
            yield _arrays(anchors, dim), _arrays(batch.column("__rows")[i].values, dim), anchors


def _first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """Of pairs sorted by (row, -score, id): which are among the first k of their row inside the mask."""
    seen = np.cumsum(inside)
    start = np.searchsorted(row, row)  # where each pair's row begins
    before = np.concatenate(([0], seen))[start]
    return inside & (seen - before <= k)


def _positives(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each anchor in each block of its label."""
    for a, b, _ in _block_pairs(batches, dim):
        for lo in range(0, len(a["__uid"]), _SLICE):
            uid = a["__uid"][lo : lo + _SLICE]
            score = a["__v"][lo : lo + _SLICE] @ b["__v"].T
            score[uid[:, None] == b["__uid"]] = -np.inf
            least = np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]] if score.shape[1] > k else -np.inf
            row, col = np.nonzero((score >= least) & (score > -np.inf))
            s, ids = score[row, col], b["__id"][col]
            order = np.lexsort((ids, -s, row))
            row, s, ids = row[order], s[order], ids[order]
            keep = _first(row, s, ids, np.ones(len(row), bool), k)
            yield pa.RecordBatch.from_arrays([pa.array(uid[row[keep]]), pa.array(s[keep]), pa.array(ids[keep])], ["__uid", "score", "id"])


def _negatives(batches: Iterator[pa.RecordBatch], dim: int, k: int, low: int) -> Iterator[pa.RecordBatch]:
    """Packed keys of the rows that are among the first k of a window in a block."""
    for a, b, anchors in _block_pairs(batches, dim):
        tops = anchors.field("__p_scores")
        n = np.diff(tops.offsets.to_numpy())
        top = np.full((len(n), n.max(initial=0)), np.nan)
        top[np.arange(top.shape[1]) < n[:, None]] = tops.flatten().to_numpy()
        for lo in range(0, len(n), _SLICE):
            part = slice(lo, lo + _SLICE)
            score, t = a["__v"][part] @ b["__v"].T, top[part]
            inside = (a["__l1"][part, None] != b["__l1"]) | (a["__l2"][part, None] != b["__l2"])
            inside &= (score <= np.nanmax(t, axis=1)[:, None]) & (100 * score >= low * np.nanmin(t, axis=1)[:, None])
            row, col = np.nonzero(inside)
            s, ids = score[row, col], b["__id"][col]
            order = np.lexsort((ids, -s, row))
            row, s, ids = row[order], s[order], ids[order]
            keep = np.zeros(len(row), bool)
            for w in t.T:
                keep |= _first(row, s, ids, (s <= w[row]) & (100 * s >= low * w[row]), k)
            row = row[keep] + lo
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array([pack(a["__id"][row], a["__uid"][row], s[keep], _NEGATIVE, ids[keep])], pa.binary())], ["keys"])


def _positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("__id", "__uid", "score", "id")]
        if len(b):
            yield pa.RecordBatch.from_arrays([pa.array([pack(*cols[:3], _POSITIVE, cols[3])], pa.binary())], ["keys"])


# -- the operator -------------------------------------------------------------

def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, id_col: str = "id", vec_col: str = "vector",
         label_col: str = "label", block: int = 4096, hot_share: float = 1e-3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    of an anchor's best ``positives`` the first ``negatives`` rows of other labels scoring
    between ``low_percent`` of it and all of it."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("__id"), F.transform(vec_col, lambda x: x.cast("double")).alias("__v"), is_anchor.alias("__anchor"),
        F.xxhash64(F.lit(1), label_col).alias("__l1"), F.xxhash64(F.lit(2), label_col).alias("__l2"),
    ).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vectors.valid(F.col("__v")))
    rows = rows.withColumns({"__anchor": F.coalesce("__anchor", F.lit(False)), "__uid": F.monotonically_increasing_id()})
    rows = written(rows, "hard-negatives-rows")
    total, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("__v")), F.lit(0))).first()

    # positives: anchors meet the blocks of their label
    label = ["__l1", "__l2"]
    hot = rows.groupBy(*label).agg(F.count("*").alias("__n")).where(F.col("__n") > max(block, hot_share * total))
    hot = hot.select(*label, F.ceil(F.col("__n") / block).cast("int").alias("__parts"))
    dealt = rows.join(F.broadcast(hot), label, "left").fillna(1, ["__parts"])  # hot: at most 1 / hot_share rows
    part = F.pmod(F.xxhash64("__uid"), F.col("__parts")).cast("int")
    fields = list(_ROW)
    stored = _packed(dealt.withColumn("__part", part), "__rows", block, [*label, "__part"], fields)
    asking = _packed(dealt.where("__anchor").withColumn("__own", part), "__anchors", block, [*label, "__parts", "__own"], fields)
    asking = asking.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts", "__own")
    # merge joins: sizes after compression say little about what a broadcast of blocks would take
    met = asking.hint("merge").join(stored, [*label, "__part"]).select("__anchors", "__rows")
    found = met.mapInArrow(lambda b: _positives(b, dim, positives), _PAIRS)
    place = F.row_number().over(Window.partitionBy("__uid").orderBy(F.desc("score"), "id"))
    best = found.withColumn("__place", place).where(F.col("__place") <= positives)
    best = written(best.groupBy("__uid").agg(F.collect_list(F.struct("score", "id")).alias("__best")), "hard-negatives-positives")

    # negatives: anchors with their windows meet all blocks
    # as many anchors as a hundredth of the rows can have: a merge join at every size
    anchors = rows.where("__anchor").hint("merge").join(best, "__uid")
    anchors = written(anchors.withColumn("__p_scores", F.col("__best.score")), "hard-negatives-anchors")
    units = max(1, -(-total // block))
    unit = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    stored = _packed(rows.withColumn("__unit", unit("__uid", units)), "__rows", block, ["__unit"], fields)
    asking = _packed(anchors.withColumn("__own", unit("__uid", max(1, units // 64))), "__anchors", block, ["__own"], [*fields, "__p_scores"])
    asking = asking.withColumn("__unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))).drop("__own")
    met = asking.hint("merge").join(stored, "__unit").select("__anchors", "__rows")
    keys = met.mapInArrow(lambda b: _negatives(b, dim, negatives, low_percent), "keys binary")
    opens = anchors.select("__id", "__uid", F.explode("__best").alias("__b")).select("__id", "__uid", "__b.score", "__b.id")
    keys = keys.union(opens.mapInArrow(_positive_keys, "keys binary"))

    # secondary sort: an anchor's keys in one partition, by falling score
    size = _KEY.itemsize
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.flatMap(lambda r: ((bytes(r[0][i : i + size]), None) for i in range(0, len(r[0]), size)))
    ordered = pairs.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:16]) % n)
    mined = ordered.mapPartitions(lambda kv: windows((key for key, _ in kv), negatives, low_percent))
    return spark.createDataFrame(mined, _OUT, verifySchema=False)
