"""Registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from starmart.llm import (
    bpe, embed_dedup, hard_negatives, html_extract, langid, linededup, lm_score, mixing, periodic_runs, pii, quality, simhash, topk, vectors,
)
from starmart.llm.common import held_out, squeezed, table, unsqueezed, written
from starmart.llm.labelled_pages import labelled_pages
from starmart.plans.joins import broadcast_bound, fits_broadcast

Query = Callable[[SparkSession, str], DataFrame]
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda x: F.when(vectors.finite(x), F.floor(x.cast("double") * 64).cast("double"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("v"))
    hits = topk.top_k(vecs, F.col("vec_id") % 20 == 0, k=20, id_col="vec_id", vec_col="v")
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embed_dedup.near_duplicates(vecs, "vec_id", "embedding", threshold=0.95)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good text are the target, all others the background."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if fits_broadcast(good, broadcast_bound(spark)):  # no text moves
        return lm_score.score_corpus(docs.join(F.broadcast(good), "doc_id", "left").withColumn("target", F.col("target").isNotNull()), "target")
    # more labelled ids than that: a merge join, made once, of texts in a third of their space
    docs = squeezed(docs, "text").hint("merge").join(good, "doc_id", "left")
    docs = unsqueezed(written(docs.withColumn("target", F.col("target").isNotNull()), "lm-documents"), "text")
    return lm_score.score_corpus(docs, "target")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = quality.fit(docs, labels)
    return quality.classify(docs.withColumn("held_out", held_out("doc_id")), model).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep_text=False).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_extract.extract(pages, html_extract.train(labelled_pages())).drop("html")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_recurring_lines(docs)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = simhash.with_fingerprints(docs, shingle=4).drop("text")
    groups = simhash.near_duplicate_groups(prints, radius=4)
    return groups.select("doc_id", simhash.hex16("fingerprint").alias("fingerprint"), "component_id", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector bears the next label, so that near neighbours differ in label."""
    whole = lambda x: F.when(vectors.finite(x), F.floor(x.cast("double") * 256).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("v"), label.alias("label"))
    mined = hard_negatives.mine(vecs, F.col("vec_id") % 100 == 0, id_col="vec_id", vec_col="v")
    return mined.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of base spans; ``spans`` lists all."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cycled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs).withColumn("top", periodic_runs.longest())
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def cycled(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, picked by the hash h of the id, repeat some of their words to the end:
    from word a on, every word becomes the one at a plus its distance to a modulo p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    n, g = F.size("__words"), F.floor(h / 10).cast("long")
    docs = docs.withColumn("__words", F.when(h % 10 == 0, words))
    docs = docs.withColumn("__words", F.when(n > 0, F.col("__words")))  # also null where there is no word
    a = F.expr("int(__g % size(__words))")
    p = F.expr("int(1 + (size(__words) - __a) div (3 + __g % 8))")
    cycle = F.expr("transform(__words, (w, i) -> if(i < __a, w, __words[__a + (i - __a) % __p]))")
    docs = docs.withColumn("__g", g).withColumn("__a", a).withColumn("__p", p)
    text = F.when(F.col("__words").isNotNull(), F.array_join(cycle, " ")).otherwise(F.col("text"))
    return docs.withColumn("text", text).drop("__words", "__g", "__a", "__p")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_topk, op2_embedding_dedup, op3_lm_score, op4_byte_bpe, op5_language_id, op6_quality, op7_mixing,
                              op8_html_extraction, op9_line_dedup, op10_simhash, op11_hard_negatives, op12_pii, op13_periodic_runs, pipeline)
}
ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT q.vec_id AS query_id, row_number() OVER w AS rank, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)
        QUALIFY rank <= 20""",
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
        SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
        FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id""",
    # templates as strings instead of hashes; segment s of a line keeps the tokens before cut(s) and after cut(s + 1)
    "op9_line_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, text FROM documents),
        parts AS (SELECT r, d, string_split(text, chr(10)) AS ls FROM docs WHERE text IS NOT NULL),
        lines AS (SELECT r, d, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM parts),
        tokens AS (SELECT r, d, pos, line, list_filter(string_split_regex(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM lines),
        parted AS (SELECT r, d, pos, len(t) AS n, array_to_string(t[1:2], ' ') AS h,
                          list_transform([0, 1, 2, 3], lambda s: array_to_string(t[2 + (len(t) - 2) * s // 4 + 1 : 2 + (len(t) - 2) * (s + 1) // 4], ' ')) AS g
                   FROM tokens WHERE len(t) >= 5),
        keys AS (SELECT r, d, pos, 'all' || array_to_string(t, ' ') AS k FROM tokens WHERE len(t) BETWEEN 3 AND 4
                 UNION ALL
                 SELECT r, d, pos, n || '/' || a || b || ' ' || h || ' '
                        || array_to_string(list_transform([0, 1, 2, 3], lambda s: CASE WHEN s IN (a, b) THEN '<*>' ELSE g[s + 1] END), ' ')
                 FROM parted, (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b)
                 WHERE n < 12 AND a = b OR n >= 12 AND a < b),
        firsts AS (SELECT k, min(d) AS f FROM keys GROUP BY k HAVING min(d) < max(d)),
        drops AS (SELECT DISTINCT r, pos FROM keys JOIN firsts USING (k) WHERE d > f),
        kept AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (x.r IS NULL) AS text, count(*) AS n_lines, count(x.r) AS n_dropped
                 FROM lines l LEFT JOIN drops x ON x.r = l.r AND x.pos = l.pos GROUP BY l.r)
        SELECT docs.doc_id, CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
        FROM docs LEFT JOIN kept ON kept.r = docs.r""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
                          list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.l = c.l AS same, list_dot_product(a.e, c.e)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER w AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
        QUALIFY rank <= 5""",
}
