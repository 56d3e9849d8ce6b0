"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Ids travel as one binary value per text (unsigned 32-bit integers, little
endian), which is what a training job packs; ``unpack_ids`` turns them into an
array column.  Special tokens are never produced.

Defined results: a null text encodes like the empty one (no ids, no bytes); the
same text always gives the same ids, so ties and repeated rows need no care; an
empty table gives an empty table; other columns pass through, and one named like
an output is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The characters of Unicode White_Space, which \s stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"[^{SPACE}](?=[{SPACE}])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[\u4e00-\u9fff](?=[\u3001\u3002\uff0c])")
_RUN = re.compile(f"[{SPACE}]{{65536,}}")


_WHOLE = r"(?s).+"  # a pattern that takes its whole input as a single match


@functools.lru_cache(maxsize=4)
def _encoding(ranks_file: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines()) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """Cut a long text where the split pattern always ends a match.

    Such places are: before white space that follows something else, and between
    an ASCII letter and digit or a CJK letter and its punctuation.  A very long
    run of white space is one match, less its last character if text follows
    (that one belongs to the next match); it comes out as (run, True), to be
    encoded whole, because the pattern's engine cannot look that far ahead.
    """
    at = 0
    for run in _RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in _cut(text[at : run.start()], size))
        yield text[run.start() : stop], True
        at = stop
    yield from ((p, False) for p in _cut(text[at:], size))


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        yield text[at : edge.end()]
        at = edge.end()
    if at < len(text):
        yield text[at:]


def encode_text(text: str | None, ranks_file: bytes, pattern: str, piece: int) -> bytes:
    if not text:
        return b""
    if len(text) <= piece:
        return _little(array("I", _encoding(ranks_file, pattern).encode_ordinary(text)))
    ids = array("I")
    for part, run in safe_pieces(text, piece):
        ids.extend(_encoding(ranks_file, _WHOLE if run else pattern).encode_ordinary(part))
    return _little(ids)


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def decode_ids(packed: bytes | None, ranks_file: bytes, pattern: str) -> bytes:
    if not packed:
        return b""
    ids = array("I")
    ids.frombytes(packed)
    return _encoding(ranks_file, pattern).decode_bytes(ids.tolist())


def _map(fn):
    """A function of one value as an Arrow function that answers slice by slice.

    One Arrow batch may hold many long texts; results leave in a builder of the
    same rows, so memory is a small multiple of the batch.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fn(v.as_py()) for v in batch], pa.binary())
    return F.arrow_udf(run, BinaryType())


def _ranks(df: DataFrame, path: str):
    """The rank file's bytes (about 1 MB; bounded by the vocabulary) on every executor."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           piece: int = 1 << 16) -> DataFrame:
    """Add ``ids_col`` (packed ids) for the whole ``text_col``."""
    ranks = _ranks(df, ranks_path)
    return df.withColumn(ids_col, _map(lambda t: encode_text(t, ranks.value, pattern, piece))(F.col(text_col)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the raw bytes that the packed ids stand for."""
    ranks = _ranks(df, ranks_path)
    return df.withColumn(out_col, _map(lambda b: decode_ids(b, ranks.value, pattern))(F.col(ids_col)))


def encode_verified(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
                    hash_col: str = "decoded_sha256", piece: int = 1 << 16) -> DataFrame:
    """Add ``ids_col`` and ``hash_col``: SHA-256 (hex) of the bytes that those ids decode to.

    Encodes and decodes a text in one pass through one Python worker, and the
    decoded bytes stay there.
    """
    ranks = _ranks(df, ranks_path)

    @F.arrow_udf("struct<ids: binary, hash: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = pa.array((encode_text(v.as_py(), ranks.value, pattern, piece) for v in batch), pa.binary())
            hashes = [hashlib.sha256(decode_ids(v.as_py(), ranks.value, pattern)).hexdigest() for v in ids]
            yield pa.StructArray.from_arrays([ids, pa.array(hashes, pa.string())], ["ids", "hash"])

    coded = df.withColumn("__bpe", run(F.col(text_col)))
    return coded.withColumns({ids_col: F.col("__bpe.ids"), hash_col: F.col("__bpe.hash")}).drop("__bpe")


def n_tokens(ids_col: str = "ids"):
    return (F.octet_length(ids_col) / 4).cast("long")


def unpack_ids(packed: bytes) -> list[int]:
    ids = array("I")
    ids.frombytes(packed)
    return ids.tolist()


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the packed ids and of the decoded bytes."""
    coded = encode_verified(df.select(id_col, text_col), ranks_path, pattern, text_col, "__ids", "decoded_sha256")
    return coded.select(id_col, n_tokens("__ids").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), "decoded_sha256")
