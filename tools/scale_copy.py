"""Derive an N-times larger copy of the test tables, for scale experiments.

    python tools/scale_copy.py SRC_DIR DST_DIR N

Each replica r of a table shifts its keys by r times the key range of the
source, so keys stay unique per table and every foreign key still finds its
parent in the same replica.  Small reference tables (region, nation) are copied
once.  All work is done by Spark from the given tables.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

# Key columns per table and the key space they belong to.
KEYS = {
    "customer": {"c_custkey": "cust"},
    "supplier": {"s_suppkey": "supp"},
    "part": {"p_partkey": "part"},
    "orders": {"o_orderkey": "order", "o_custkey": "cust"},
    "lineitem": {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supp"},
    "events": {"event_id": "event", "user_id": "user"},
    "documents": {"doc_id": "doc"},
    "labels": {"doc_id": "doc"},
}
SPACE_OF = {"cust": ("customer", "c_custkey"), "supp": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"),
            "order": ("orders", "o_orderkey"), "event": ("events", "event_id"), "user": ("events", "user_id"),
            "doc": ("documents", "doc_id")}
COPY_ONCE = ("region", "nation", "pages", "embeddings", "benchmark", "conversations")


def main(src: str, dst: str, n: int) -> None:
    from starmart.session import local_session
    spark = local_session(8)
    width = {}
    for space, (t, c) in SPACE_OF.items():
        width[space] = spark.read.parquet(f"{src}/{t}.parquet").agg(F.max(c)).first()[0] + 1
    for t in list(KEYS) + list(COPY_ONCE):
        df = spark.read.parquet(f"{src}/{t}.parquet")
        if t not in COPY_ONCE:
            df = df.withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
            for c, space in KEYS[t].items():
                df = df.withColumn(c, (F.col(c) + F.col("__r") * F.lit(width[space])).cast(df.schema[c].dataType))
            df = df.drop("__r")
        df.write.mode("errorifexists").parquet(f"{dst}/{t}.parquet")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]))
