"""Helpers for vector operators: valid vectors, distinct vectors, packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def valid(vec: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, finite), F.lit(False))


def keys(vec: str = "__v") -> dict[str, Column]:
    """A 128-bit key of a vector, in two columns."""
    return {"__k1": F.xxhash64(F.lit(1), vec), "__k2": F.xxhash64(F.lit(2), vec)}


def sample(distinct: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` of the distinct vectors ``__v``, those with the smallest keys, as a matrix."""
    got = distinct.select("__k1", "__k2", "__v").orderBy("__k1", "__k2").limit(rows).collect()
    dim = max((len(r["__v"]) for r in got), default=0)
    out = np.zeros((len(got), dim))
    for i, r in enumerate(got):
        out[i, : len(r["__v"])] = r["__v"]
    return out


def matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """List array to (rows, dim); shorter vectors are padded with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(vectors.offsets.to_numpy())
    if len(n) == 0 or (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def kmeans(x: np.ndarray, k: int, spherical: bool, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows of x (which the caller has in hashed order)."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = x @ c.T if spherical else 2 * x @ c.T - (c * c).sum(axis=1)
        own = np.argmax(near, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))[:, None]
        moved = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True) if spherical else n, 1e-12)
        c = np.where(n > 0, moved, c)
    return c
