"""Exact top-k search by inner product with a pivot-distance index.

Inner products become distances: with M the largest squared norm, v gets the
coordinate sqrt(M - |v|**2) and a query q gets 0, so |q - v|**2 = |q|**2 + M - 2 q.v
and the nearest vectors are those with the highest scores.  Each vector is keyed
by its nearest pivot and the distance to it; the distances of a pivot are cut into
annuli.  For a query at distance d from a pivot, no vector of an annulus [lo, hi]
is nearer than max(lo - d, d - hi, 0).

Search in two rounds of joins.  First every query visits the annuli with the
smallest bounds until they hold k + 1 vectors, which gives its k-th best score so
far.  Then it visits every annulus whose bound does not rule out that score;
beyond them the search stops.  Both rounds join blocks of queries with blocks of an
annulus, and scores come from one matrix product per pair of blocks.

Pivots and annulus edges are fitted to a bounded sample (``sample`` vectors); all
vectors are indexed, and the bounds lo and hi are those of all vectors.  The number
of annuli follows the number of vectors up to ``max_pivots`` pivots, so what is
broadcast is bounded; larger annuli hold more blocks.  Equal vectors are one entry
that keeps the k + 1 smallest ids, which is all that a result can show of them, and
queries with equal vectors are searched once.

Defined results: vectors that are null or hold null or non-finite components take
no part, neither do null ids; shorter vectors count as padded with zeros; equal
scores go to the smaller id; a row is no candidate of itself, another row with the
same id is; scores are exact while sums stay below 2**53; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm import vectors
from starmart.llm.common import written

_HITS = "k1 long, k2 long, score double, id long, same boolean"
_SLICE = 512  # queries whose scores are held at once


@dataclass
class PivotIndex:
    dim: int
    top_norm: float        # M
    pivots: np.ndarray     # (pivots, dim + 1)
    edges: np.ndarray      # (pivots, rings - 1)
    lo: np.ndarray         # (cells,)
    hi: np.ndarray
    count: np.ndarray

    @property
    def rings(self) -> int:
        return self.edges.shape[1] + 1

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot, of vectors."""
        last = np.sqrt(np.maximum(self.top_norm - (v * v).sum(axis=1), 0))
        d = _distances(np.hstack([v, last[:, None]]), self.pivots)
        pivot = np.argmin(d, axis=1)
        d = d[np.arange(len(v)), pivot]
        ring = (self.edges[pivot] < d[:, None]).sum(axis=1)
        return pivot * self.rings + ring, d

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells): no vector of the cell has a higher score; -inf for empty cells."""
        d = np.repeat(_distances(np.hstack([q, np.zeros((len(q), 1))]), self.pivots), self.rings, axis=1)
        least = np.maximum(np.maximum(self.lo - d, d - self.hi), 0)
        norm = (q * q).sum(axis=1)[:, None] + self.top_norm
        # rounding of distances must not rule out an equal score
        upper = (norm - least * least) / 2 + 1e-7 * (1 + norm)
        return np.where(self.count > 0, upper, -np.inf)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0))


def fit(distinct: DataFrame, sample: int, rows_per_cell: int, rings: int, max_pivots: int) -> PivotIndex:
    norm = F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, top = distinct.agg(F.count("*"), F.max(F.size("__v")), F.max(norm)).first()
    dim, top = dim or 0, top or 0.0
    if not n:
        return PivotIndex(0, 0.0, np.zeros((1, 1)), np.zeros((1, rings - 1)), np.zeros(rings), np.zeros(rings), np.zeros(rings, np.int64))
    x = vectors.sample(distinct, sample)
    x = np.hstack([x, np.zeros((len(x), dim - x.shape[1]))])
    x = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])
    pivots = vectors.kmeans(x, max(1, min(max_pivots, math.ceil(n / (rows_per_cell * rings)))), spherical=False)
    d = _distances(x, pivots)
    own = np.argmin(d, axis=1)
    near = d[np.arange(len(x)), own]
    at = np.arange(1, rings) / rings
    edges = np.array([np.quantile(near[own == p], at) if (own == p).any() else np.zeros(rings - 1) for p in range(len(pivots))]).reshape(-1, rings - 1)
    cells = len(pivots) * rings
    return PivotIndex(dim, top, pivots, edges, np.zeros(cells), np.zeros(cells), np.zeros(cells, np.int64))


def _hits(rows: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of each query in each pair of blocks."""
    for batch in rows:
        for at in range(batch.num_rows):
            vs, qs = batch.column("__vectors")[at], batch.column("__queries")[at]
            v, ids = vs.values, vs.values.field("__ids")
            m = vectors.matrix(v.field("__v"), dim)
            v1, v2 = (v.field(c).to_numpy() for c in ("__k1", "__k2"))
            first, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
            n_ids = np.diff(first)
            q = qs.values
            qm, floor = vectors.matrix(q.field("__v"), dim), q.field("__floor").to_numpy()
            q1, q2 = (q.field(c).to_numpy() for c in ("__k1", "__k2"))
            for lo in range(0, len(q), _SLICE):
                w = np.arange(lo, min(lo + _SLICE, len(q)))
                score = qm[w] @ m.T
                least = floor[w]
                if m.shape[0] > k:
                    least = np.maximum(least, np.partition(score, m.shape[0] - k, axis=1)[:, m.shape[0] - k])
                i, j = np.nonzero(score >= least[:, None])
                n = n_ids[j]
                row, col = np.repeat(i, n), np.repeat(j, n)
                own = flat[np.repeat(first[j], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
                s = score[row, col]
                order = np.lexsort((own, -s, row))
                row, col, own, s = row[order], col[order], own[order], s[order]
                start = np.searchsorted(row, np.arange(len(w)))
                keep = np.arange(len(row)) - start[row] < k
                row, col, own, s = w[row[keep]], col[keep], own[keep], s[keep]
                same = (q1[row] == v1[col]) & (q2[row] == v2[col])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q1[row], q2[row], s, own, same)], ["k1", "k2", "score", "id", "same"])


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "id", vec_col: str = "vector", sample: int = 4096,
          rows_per_cell: int = 512, rings: int = 4, max_pivots: int = 256, block: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each query row of ``df`` with the other rows."""
    rows = df.select(
        F.col(id_col).cast("long").alias("__id"), F.transform(vec_col, lambda x: x.cast("double")).alias("__v"), is_query.alias("__query")
    ).where(F.col("__id").isNotNull() & vectors.valid(F.col("__v"))).withColumns(vectors.keys())
    rows = written(rows.withColumn("__query", F.coalesce("__query", F.lit(False))), "topk-rows")
    # equal vectors: one entry with its k + 1 smallest ids (a group limit runs before the shuffle)
    place = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__id"))
    few = rows.select("__k1", "__k2", "__id", "__v").withColumn("__n", place).where(F.col("__n") <= k + 1)
    distinct = written(few.groupBy("__k1", "__k2").agg(F.any_value("__v").alias("__v"), F.collect_list("__id").alias("__ids")), "topk-distinct")
    sc = df.sparkSession.sparkContext

    index = fit(distinct, sample, rows_per_cell, rings, max_pivots)
    plain = sc.broadcast(index)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = plain.value.keys(vectors.matrix(b.column("__v"), plain.value.dim))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__k1", "__k2", "__v", "__ids")), pa.array(cell.astype(np.int32)), pa.array(d)],
                                             ["__k1", "__k2", "__v", "__ids", "__cell", "__d"])

    keyed = written(distinct.select("__k1", "__k2", "__v", "__ids").mapInArrow(
        key, "__k1 long, __k2 long, __v array<double>, __ids array<long>, __cell int, __d double"), "topk-index")
    for r in keyed.groupBy("__cell").agg(F.min("__d"), F.max("__d"), F.count("*")).collect():  # bounded by the number of cells
        index.lo[r[0]], index.hi[r[0]], index.count[r[0]] = r[1], r[2], r[3]
    shared = sc.broadcast(index)

    def blocks(of: DataFrame, name: str, *fields: str) -> DataFrame:
        """Rows of a cell packed into arrays of about ``block`` rows."""
        n = of.groupBy("__cell").agg(F.ceil(F.count("*") / block).alias("__blocks"))
        part = F.pmod(F.col("__k1"), F.col("__blocks"))
        return of.join(F.broadcast(n), "__cell").groupBy("__cell", part.alias("__part")).agg(F.collect_list(F.struct(*fields)).alias(name)).drop("__part")

    stored = written(blocks(keyed, "__vectors", "__k1", "__k2", "__v", "__ids"), "topk-blocks")
    queries = written(rows.where("__query").select("__k1", "__k2").distinct().join(distinct.select("__k1", "__k2", "__v"), ["__k1", "__k2"]), "topk-queries")

    def first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells with the highest bounds until they hold k + 1 vectors."""
        m = shared.value
        for b in batches:
            bound = m.bounds(vectors.matrix(b.column("__v"), m.dim))
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(m.count[order], axis=1)
            take = (held - m.count[order] < k + 1) & (m.count[order] > 0)
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(i)) for c in ("__k1", "__k2", "__v")), pa.array(order[i, j].astype(np.int32))], ["__k1", "__k2", "__v", "__cell"])

    def scored(asked: DataFrame) -> DataFrame:
        # a merge join: sizes after compression say little about what a broadcast of blocks would take
        pairs = asked.hint("merge").join(stored, "__cell").select("__vectors", "__queries")
        return pairs.mapInArrow(lambda b: _hits(b, shared.value.dim, k + 1), _HITS)

    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id", F.desc("same"))
    start = queries.mapInArrow(first_cells, "__k1 long, __k2 long, __v array<double>, __cell int").withColumn("__floor", F.lit(float("-inf")))
    start = blocks(written(start, "topk-start"), "__queries", "__k1", "__k2", "__v", "__floor")
    floor = scored(start).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("__floor"))
    asked = written(queries.join(floor, ["__k1", "__k2"]), "topk-floor")

    # second round: for each cell the queries whose bound allows it, in blocks
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, fields = shared.value, ("__k1", "__k2", "__v", "__floor")
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                queries = pa.StructArray.from_arrays([part.column(c) for c in fields], fields)
                open_ = m.bounds(vectors.matrix(part.column("__v"), m.dim)) >= part.column("__floor").to_numpy()[:, None]
                for cell in np.flatnonzero(open_.any(axis=0) & (m.count > 0)):
                    own = queries.take(pa.array(np.flatnonzero(open_[:, cell])))
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["__cell", "__queries"])

    asking = asked.select("__k1", "__k2", "__v", "__floor").mapInArrow(
        visits, "__cell int, __queries array<struct<__k1: bigint, __k2: bigint, __v: array<double>, __floor: double>>")
    found = scored(asking).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = found.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.sort_array(F.collect_list(F.struct("n", "id", "score", "same"))).alias("__list"))
    lists = written(lists, "topk-lists")
    # each query row: its list less itself
    asking = rows.where("__query").select("__k1", "__k2", "__id").join(lists, ["__k1", "__k2"])
    me = F.array_position(F.transform("__list", lambda x: x["same"] & (x["id"] == F.col("__id"))), F.lit(True))
    others = F.slice(F.filter("__list", lambda x, i: i + 1 != F.col("__me")), 1, k)
    return asking.withColumn("__me", me).select("__id", F.posexplode(others).alias("__rank", "__hit")).select(
        F.col("__id").alias("query_id"), (F.col("__rank") + 1).alias("rank"), F.col("__hit.id").alias("id"), F.col("__hit.score").alias("score"))
