"""Embedding near-dedup by spherical k-means cells and blocked cosine products.

Each distinct vector belongs to the cell of its nearest centroid.  Cosines are
compared by matrix products between blocks of a cell, and between blocks of two
cells where a link across their border is possible: for unit vectors x of cell g
and y of cell h with cosine at least t, |x - y| <= sqrt(2 - 2 t), and x is at least
x.(g - h)/|g - h| away from everything nearer to h.  Only rows within that distance
of the border, on both sides, are compared, and cell pairs without such rows are
not joined.  So no link is lost to the cells.

Centroids are fitted to a bounded sample (``sample`` vectors); their number follows
the number of vectors up to ``max_cells``, so what is broadcast is bounded.  Equal
vectors are one row with a count.  A cell beyond ``block`` rows is several blocks
that many tasks compare.  A pair of blocks gives link counts per row and a spanning
forest of its links; connected components join the forests, and the row with the
smallest id of each group is kept.

Defined results: vectors that are null, zero, or hold null or non-finite components
link with nothing and are groups of their own; so does a vector of another length,
unless padding with zeros makes it similar; null ids count in links but are never a
group's id unless the group has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.llm import vectors
from starmart.llm.common import connected_components, written
from starmart.llm.simhash import _roots, _union

_SLICE = 512  # rows whose products are held at once


@dataclass
class Cells:
    dim: int
    centroids: np.ndarray  # (cells, dim), unit length
    reach: float           # largest distance of linked unit vectors

    def border(self, x: np.ndarray, home: np.ndarray | int) -> np.ndarray:
        """(rows, cells): distance from each row to the border between its cell and the other."""
        s = x @ self.centroids.T
        own = s[np.arange(len(x)), home] if np.ndim(home) else s[:, home]
        gap = np.sqrt(np.maximum(2 - 2 * self.centroids[home] @ self.centroids.T, 0))
        return np.where(gap > 1e-9, (own[:, None] - s) / np.maximum(gap, 1e-9), 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(batches: Iterator[pa.RecordBatch], cells: Cells, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to rows (a, b, n): a forest edge a-b, or b null and n more links of a."""
    for batch in batches:
        for at in range(batch.num_rows):
            one, other, left, right = (batch.column(c)[at] for c in ("__one", "__other", "__left", "__right"))
            one, other, inside = one.as_py(), other.as_py(), not right.is_valid
            a = _Block(left.values, cells)
            b = a if inside else _Block(right.values, cells)
            if one != other:
                a.keep(cells.border(a.x, one)[:, other] <= cells.reach)
                b.keep(cells.border(b.x, other)[:, one] <= cells.reach)
            rows = np.concatenate([a.row, [] if inside else b.row]).astype(np.int64)
            links, label, base = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0 if inside else len(a.row)
            for lo in range(0, len(a.row), _SLICE):
                i, j = np.nonzero(a.x[lo : lo + _SLICE] @ b.x.T >= least)
                i += lo
                if inside:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    links += np.bincount(i, b.n[j], len(rows)).astype(np.int64)
                    links += np.bincount(j + base, a.n[i], len(rows)).astype(np.int64)
                    _union(label, i, j + base)
            label = _roots(label)
            moved, linked = np.flatnonzero(label != np.arange(len(rows))), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows[moved], rows[linked]])),
                pa.array(np.concatenate([rows[label[moved]], np.zeros(len(linked), np.int64)]), mask=np.arange(len(moved) + len(linked)) >= len(moved)),
                pa.array(np.concatenate([np.zeros(len(moved), np.int64), links[linked]])),
            ], ["a", "b", "n"])


class _Block:
    def __init__(self, rows: pa.StructArray, cells: Cells) -> None:
        self.x = _unit(vectors.matrix(rows.field("__v"), cells.dim))
        self.row, self.n = (rows.field(c).to_numpy() for c in ("__row", "__n"))

    def keep(self, mask: np.ndarray) -> None:
        self.x, self.row, self.n = self.x[mask], self.row[mask], self.n[mask]


def near_duplicates(df: DataFrame, id_col: str = "id", vec_col: str = "vector", threshold: float = 0.95, sample: int = 8192,
                    rows_per_cell: int = 4096, max_cells: int = 1024, block: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``df``."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("__id"), F.transform(vec_col, lambda x: x.cast("double")).alias("__v"))
    linkable = vectors.valid(F.col("__v")) & F.exists("__v", lambda x: x != 0)
    rows = written(rows.withColumn("__v", F.when(linkable, F.col("__v"))).withColumns(vectors.keys()), "dedup-rows")
    distinct = written(
        rows.where("__v is not null").groupBy("__k1", "__k2")
        .agg(F.any_value("__v").alias("__v"), F.count("*").alias("__n"), F.min("__id").alias("__least"))
        .withColumn("__row", F.monotonically_increasing_id()), "dedup-distinct")

    n, dim = distinct.agg(F.count("*"), F.max(F.size("__v"))).first()
    if not n:
        return rows.select(F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    centroids = vectors.sample(distinct, sample)
    centroids = _unit(np.hstack([centroids, np.zeros((len(centroids), dim - centroids.shape[1]))]))
    centroids = vectors.kmeans(centroids, min(max_cells, math.ceil(n / rows_per_cell)), spherical=True)
    cells = Cells(dim, centroids, math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = _unit(vectors.matrix(b.column("__v"), m.dim))
            home = np.argmax(x @ m.centroids.T, axis=1)
            near = m.border(x, home) <= m.reach
            near[np.arange(len(x)), home] = False
            i, j = np.nonzero(near)
            across = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)), pa.array(j.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__row", "__n", "__v")), pa.array(home.astype(np.int32)), across],
                                             ["__row", "__n", "__v", "__cell", "__across"])

    placed = written(distinct.select("__row", "__n", "__v").mapInArrow(
        assign, "__row long, __n long, __v array<double>, __cell int, __across array<int>"), "dedup-cells")
    sizes = placed.groupBy("__cell").agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    blocks = written(
        placed.join(F.broadcast(sizes), "__cell").withColumn("__part", F.pmod(F.xxhash64("__row"), F.col("__blocks")).cast("int"))
        .groupBy("__cell", "__part").agg(F.collect_list(F.struct("__row", "__n", "__v")).alias("__rows")), "dedup-blocks")

    # cell pairs whose border is near to rows on both sides; each pair once, and each cell with itself
    sides = placed.select("__cell", F.explode("__across").alias("__to")).distinct()
    there = sides.select(F.least("__cell", "__to").alias("__one"), F.greatest("__cell", "__to").alias("__other"))
    across = there.groupBy("__one", "__other").count().where("count = 2").drop("count")
    pairs = across.union(sizes.select(F.col("__cell").alias("__one"), F.col("__cell").alias("__other")))
    left = blocks.select(F.col("__cell").alias("__one"), F.col("__part").alias("__i"), F.col("__rows").alias("__left"))
    right = blocks.select(F.col("__cell").alias("__other"), F.col("__part").alias("__j"), F.col("__rows").alias("__right"))
    units = left.hint("merge").join(pairs, "__one").hint("merge").join(right, "__other").where("__one < __other or __i <= __j")
    units = units.withColumn("__right", F.when((F.col("__one") < F.col("__other")) | (F.col("__i") < F.col("__j")), F.col("__right")))
    found = written(units.select("__one", "__other", "__left", "__right").mapInArrow(
        lambda b: _compare(b, shared.value, threshold), "a long, b long, n long"), "dedup-links")

    comps = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("__row")).agg(F.sum("n").alias("__links"))
    groups = distinct.drop("__v").join(comps.withColumnRenamed("node", "__row"), "__row", "left").withColumn("component", F.coalesce("component", "__row"))
    least = groups.groupBy("component").agg(F.min("__least").alias("__first"))
    info = groups.join(least, "component").join(links, "__row", "left").select(
        "__k1", "__k2", "__first", (F.coalesce("__links", F.lit(0)) + F.col("__n") - 1).alias("__links"))
    out = rows.select("__id", F.col("__v").isNull().alias("__alone"), "__k1", "__k2")
    linked = out.where("not __alone").join(info, ["__k1", "__k2"]).select("__id", "__links", "__first")
    alone = out.where("__alone").select("__id", F.lit(0).cast("long"), "__id")
    return linked.union(alone).select(
        F.col("__id").alias(id_col), F.col("__links").alias("n_links"), F.col("__first").alias("component_id"),
        F.col("__id").eqNullSafe(F.col("__first")).alias("kept"))
