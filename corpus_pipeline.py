"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns the columns of ``documents`` (the last adds tokens); :func:`run`
writes each stage's rows as Parquet in the shared folder and reads them again, so
a lost executor never reaches behind the current stage.  A null or empty text
does not stop a stage; an empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm import bpe, langid, linededup, mixing, simhash
from starmart.llm.common import held_out, table, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language's centroids go, and those without a letter."""
    model = langid.fit(docs.where(~held_out("doc_id")))
    return langid.identify(docs, model).where("accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs stay in the first document only; n_chars follows the text."""
    rows = linededup.drop_recurring_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 4 or fewer bits stays."""
    return simhash.near_dedup(docs, shingle=4, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until each source has its target of words."""
    return mixing.repeat(mixing.mix(docs)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every text, their number, and whether they decode to the text."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.encode_verified(docs, path, pattern)
    exact = F.col("decoded_sha256") == F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return coded.withColumns({"n_tokens": bpe.n_tokens(), "round_trip": exact}).drop("decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: The first stage fits a model and the others hash with XXH64: SQL cannot express them
#: (tests/llm/test_pipeline.py holds run() against a brute-force version).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs
