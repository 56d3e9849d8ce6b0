import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from starmart.llm import bpe, queries

from .conftest import SMALL

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_library(spark, documents, plain):
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, SMALL).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids, row = plain.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert len(got) == documents.count()


def test_pieces_give_the_ids_of_the_whole_text(plain):
    rng = random.Random(3)
    parts = ["it's", " we'll", "the", "  ", "\n\n", " 12ab34", "é", "漢字、漢", "!?", "'", " ", "　", " x", "1", "A", "\t"]
    ranks = open(PATH, "rb").read()
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 120)))
        for size in (1, 5, 20):
            assert "".join(p for p, _ in bpe.safe_pieces(text, size)) == text
            assert bpe.unpack_ids(bpe.encode_text(text, ranks, P.PATTERN, size)) == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 100_000 + "x", "x" + "\n" * 100_000, " " * 99_999 + "\n7", "ab" * 100_000, "a" + " \n" * 70_000 + "b c"])
def test_long_runs_equal_the_library(plain, text):
    ranks = open(PATH, "rb").read()
    assert bpe.unpack_ids(bpe.encode_text(text, ranks, P.PATTERN, 1 << 16)) == plain.encode_ordinary(text)


def test_run_beyond_the_library(plain):
    text = " " * 1_500_000 + "x"
    ranks = open(PATH, "rb").read()
    assert bpe.decode_ids(bpe.encode_text(text, ranks, P.PATTERN, 1 << 16), ranks, P.PATTERN) == text.encode()


def test_nasty_rows_round_trip(nasty):
    rows = bpe.decode(bpe.encode(nasty, PATH, P.PATTERN), PATH, P.PATTERN)
    assert rows.columns.count("ids") == 1 and dict(rows.dtypes)["ids"] == "binary"
    bad = rows.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary"))
    assert bad.count() == 0 and rows.count() == nasty.count()
    assert bpe.encode(nasty.limit(0), PATH, P.PATTERN).count() == 0
