import corpus_pipeline
from pyspark.sql import functions as F

from .conftest import SMALL
from .test_linededup import brute
from .test_mixing import brute_targets
from .test_simhash import brute_components, brute_print


def test_stages_against_brute_force(spark, documents):
    """Every stage on its predecessor's rows; mixing by its targets, tokens by their round trip."""
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = documents.cache()
    known = stage["language ID"](spark, docs, SMALL).cache()
    assert known.schema == docs.schema and known.count() == docs.count()  # all are prose of known languages
    lines = stage["line dedup"](spark, known, SMALL).cache()
    want = {i: t for (i, _), t in brute([(r["doc_id"], r["text"]) for r in known.collect()]).items()}
    assert lines.columns == docs.columns and {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    near = stage["SimHash near-dedup"](spark, lines, SMALL).cache()
    ids = sorted(want)
    comps = brute_components([(i, brute_print(want[i])) for i in ids])
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.select("doc_id").collect()) == sorted(set(comps))
    mixed = stage["mixing sources to target weights"](spark, near, SMALL).cache()
    words = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda t: t != ""))).alias("n")).collect()}
    target, got = brute_targets(words(near)), words(mixed)
    longest = max(len(t.split()) for t in want.values())
    assert mixed.columns == docs.columns and all(abs(got.get(s, 0) - target[s]) <= longest / 2 + 1 for s in target)
    coded = stage["byte-level BPE encoding and decoding"](spark, mixed, SMALL)
    assert coded.count() == mixed.count() and coded.where("not round_trip or n_tokens is null").count() == 0


def test_run(spark, tmp_path, nasty):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    nasty.select(*cols).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == cols + ["ids", "n_tokens", "round_trip"]
    nasty.select(*cols).limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
