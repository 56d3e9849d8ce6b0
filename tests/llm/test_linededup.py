import itertools
import re

import pytest
from pyspark.sql import functions as F

from starmart.llm import linededup, queries

from .conftest import SMALL


def brute(rows, min_tokens=3, min_general=5, min_two=12, depth=2, segments=4):
    """{(id, text): kept text} by comparing templates in plain Python; a null id is last."""
    last = 2**63 - 1

    def templates(line):
        t = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[0-9]+", "0", line)) if x]
        if len(t) < min_tokens:
            return []
        if len(t) < min_general:
            return [(len(t), tuple(t))]
        cut = [depth + (len(t) - depth) * s // segments for s in range(segments + 1)]
        fields = itertools.combinations(range(segments), 2 if len(t) >= min_two else 1)
        return [(len(t), f, tuple(t[:depth]), *(tuple(t[cut[s] : cut[s + 1]]) for s in range(segments) if s not in f)) for f in fields]

    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            for k in templates(line):
                first[k] = min(first.get(k, last), last if i is None else i)
    return {
        (i, text): None if text is None else "\n".join(x for x in text.split("\n") if all(first[k] >= (last if i is None else i) for k in templates(x)))
        for i, text in rows
    }


def test_query_against_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want = {i: t for (i, _), t in brute(docs).items()}
    got = {r["doc_id"]: r for r in queries.op9_line_dedup(spark, SMALL).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    for i, text in docs:
        assert got[i]["n_lines"] == text.count("\n") + 1
        assert (got[i]["n_dropped"] > 0) == (want[i] != text)


def test_variable_fields(spark):
    log = "login of user {} accepted from host alpha at port {} with the session key renewed for one hour"
    rows = [(1, log.format("ann", 80) + "\nown line of one"), (2, "own line of two\n" + log.format("bob", 8080)), (3, "short\nshort"), (4, "short")]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own line of two", 3: "short\nshort", 4: "short"}


def test_variable_words_of_short_and_long_lines(spark):
    short, long = "Posted by {} in sports today", "on {} the {} was {} by the team of the house and its {} friends at noon"
    rows = [
        (1, short.format("alice")), (2, short.format("bob")), (3, "Posted by carol in politics today"),
        (4, "Report " + long.format("monday", "match", "won", "old")), (5, "Report " + long.format("sunday", "match", "lost", "old")),
        (6, "Report " + long.format("friday", "game", "drawn", "new")),
        (7, "Back to top now"), (8, "Back to bottom now"),
    ]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 2: "", 5: ""}
    assert got == {i: t for (i, _), t in brute(rows).items()}


@pytest.mark.parametrize("kind", ["string", "int", "decimal(9,2)", "date"])
def test_ids_of_any_type(spark, kind):
    values = ["2020-01-01", "2020-01-02", None] if kind == "date" else ["b1", "b2", None] if kind == "string" else ["1", "2", None]
    df = spark.createDataFrame([(v, "the same line here") for v in values], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = [r["text"] for r in linededup.drop_recurring_lines(df).orderBy(F.asc_nulls_last("doc_id")).collect()]
    assert got == ["the same line here", "", ""]


def test_hot_line_is_not_dealt_to_one_task(spark):
    """Rows of a line in a third of all documents are marked where they are read."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "all rights are reserved\n").otherwise(""), F.lit("w x "), F.translate(F.hex("id"), "0123456789", "ghijklmnop"), F.lit(" z")).alias("text"))
    plan = linededup.dropped_lines(df)
    joins = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 3 and sum("broadcast" in x for x in joins) >= 2
    assert plan.count() == 2999


# No two share a word: lines that differ in one word are of one template.
OWN = ["red stone", "old river", "wide field", "cold wind", "long road", "high wall", "deep well", "dark wood"]


def test_shared_passage_and_copies(spark):
    passage = " ".join(f"p{i}x" for i in range(60))
    rows = [(i, f"{OWN[i]} own number of it here\n{passage}\nand its end {OWN[i]}") for i in range(8)] + [(20, "alone in this world"), (21, "alone in this world")]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and all(passage not in got[i] and "own number" in got[i] and "its end" in got[i] for i in range(1, 8))
    assert (got[20], got[21]) == ("alone in this world", "")


def test_nasty_rows(nasty):
    out = linededup.drop_recurring_lines(nasty)
    assert out.columns == nasty.columns + ["n_lines", "n_dropped"]
    want = brute([(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()])
    for r in out.collect():
        assert (r["text"] is None) == ((r["doc_id"], None) in want) or r["text"] is not None
    assert sorted(str(r["text"]) for r in out.select("text").collect()) == sorted(
        str(want[(r["doc_id"], r["text"])]) for r in nasty.select("doc_id", "text").collect())
    assert linededup.drop_recurring_lines(nasty.limit(0)).count() == 0


def test_native_plan(documents):
    plan = linededup.drop_recurring_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("hot", [5000])
def test_line_in_every_document(spark, hot):
    df = spark.range(hot).select(F.col("id").alias("doc_id"), F.concat(F.lit("all rights are reserved\nnumber of "), F.conv(F.hex("id"), 16, 36)).alias("text"))
    out = linededup.drop_recurring_lines(df)
    assert out.where("text like 'all rights%'").count() == 1


def test_sql_equals_brute_force():
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = con.execute(queries.ORACLE_SQL["op9_line_dedup"]).fetchall()
    assert {r[0]: r[1] for r in got} == {i: t for (i, _), t in brute(docs).items()}
