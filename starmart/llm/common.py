"""Helpers shared by the operators: reading, lineage cuts, connected components.

Internal columns start with ``__`` so they do not meet the columns of a user's
table; an operator that adds a column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs read it, so a
    lost executor costs one task and not the whole lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeezed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``text_col`` as Zstandard frames, to be moved or written in a third of the space."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.array([None if v is None else press.compress(v) for v in (x.as_py() for x in batch.cast(pa.binary()))], pa.binary())

    return df.withColumn(text_col, run(F.col(text_col)))


def unsqueezed(df: DataFrame, text_col: str) -> DataFrame:
    """The texts of :func:`squeezed` again."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            yield pa.array([None if v is None else press.decompress(v) for v in (x.as_py() for x in batch)], pa.binary()).view(pa.string())

    return df.withColumn(text_col, run(F.col(text_col)))


def held_out(id_col: str) -> "F.Column":
    """True for the quarter of the ids that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached from each node.

    ``edges`` has two columns ``a`` and ``b`` of any orderable type; nodes
    without an edge do not appear.  Alternates the large-star and small-star
    steps until nothing changes (logarithmically many rounds); each round is
    two aggregations and two joins on written tables.  A hub with very many
    edges is one row on the aggregated side of a join, so a skewed join can be
    split by adaptive execution.
    """
    def star(pairs: DataFrame) -> DataFrame:
        """(u, v) pairs to (v, m) with m the smallest node around u."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(low, "u")

    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = written(cur, "cc")
    seen = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = star(large)
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(joined.select("u", F.col("m").alias("v")))).distinct()
        cur = written(small, "cc")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    members = cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = members.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return members.union(roots)
