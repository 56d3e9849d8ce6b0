import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from starmart.session import local_session
    yield local_session("*", shuffle_partitions=8, app="starmart-llm-tests")


NASTY = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, kept string, ids int"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns named like outputs."""
    words = " ".join(f"word{i % 97} and the {i % 13}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 3), (None, "some words of no id here", "en", None, 24),
        (None, None, None, None, None), (5, words, "en", "b", len(words)), (6, words + " end", "en", "b", len(words) + 4),
        (7, "the same row twice, word for word", "en", "a", 33), (7, "the same row twice, word for word", "en", "a", 33),
        (8, "x" * 200_000, "en", "b", 200_000), (9, " " * 150_000 + "tail", "en", "b", 150_004), (10, "\n" * 70_000, "en", "b", 70_000),
        (11, "der die das und über größe straße", "de", "a", 33), (12, "日本語の文章、そして漢字。" * 50, "ja", "é", 650), (13, "12345 67890 !!", "en", "a", 14),
    ]
    return spark.createDataFrame([(*r, 99, "s", "k", 1) for r in rows], NASTY)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
