"""Minimal keys, inclusions, functional dependencies against brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.operators import dependencies as D
from starmart.operators import discover, profile
from starmart.operators.dims import build_dimension


def _random_table(rng, n, cols):
    return [tuple(None if rng.random() < 0.02 and c % 3 == 2 else int(rng.integers(0, top)) for c, top in enumerate(cols)) for _ in range(n)]


@pytest.fixture(scope="module")
def random_tables(spark):
    rng = np.random.default_rng(7)
    data = {"t1": _random_table(rng, 60, (8, 9, 7, 60)), "t2": _random_table(rng, 40, (40, 3, 200)), "t3": [(i, i % 5, i // 5) for i in range(50)], "t4": [(1, 1), (1, 1)], "t5": []}
    frames = {t: spark.createDataFrame(rows, ", ".join(f"{t}{'abcd'[i]} int" for i in range(n)))
              for (t, rows), n in zip(data.items(), (4, 3, 3, 2, 2))}
    return data, frames


def brute_keys(rows, width, max_width=3):
    keys = []
    for w in range(1, max_width + 1):
        for s in combinations(range(width), w):
            values = [tuple(r[i] for i in s) for r in rows]
            if not any(set(k) <= set(s) for k in keys) and len(set(values)) == len(rows) and not any(None in v for v in values):
                keys.append(s)
    return keys


def test_minimal_keys(random_tables):
    data, frames = random_tables
    got = D.minimal_keys(frames)
    for t, rows in data.items():
        want = [tuple(frames[t].columns[i] for i in k) for k in brute_keys(rows, len(frames[t].columns))]
        assert sorted(c.names for c in got if c.table == t) == sorted(want), t
    assert ("t3b", "t3c") in [c.names for c in got] and ("t3a",) in [c.names for c in got]  # beside the smaller key


def test_a_value_seen_twice_refutes_a_key_before_all_rows_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(profile, "FIRST_VALUES", 200, raising=False)
    tested, report = [], profile._key_report
    monkeypatch.setattr(profile, "_key_report", lambda tables, sets: tested.extend((t, tuple(s)) for t, s in sets) or report(tables, sets))
    rng = np.random.default_rng(5)
    rows = [(i // 4, i % 4, int(p), i if i != 5999 else 0) for i, p in enumerate(rng.integers(0, 20, 6000))]
    got = D.minimal_keys({"t": spark.createDataFrame(rows, "o int, l int, p int, almost int")})
    assert sorted(c.names for c in got) == sorted(tuple("olp"[i] if i < 3 else "almost" for i in k) for k in brute_keys(rows, 4))
    whole = [s for t, s in tested if t == "t"]
    assert ("o", "l") in whole and ("o", "p") not in whole  # the latter repeats often


def test_inclusions_and_refutation(random_tables):
    data, frames = random_tables
    found = D.inclusions(frames, k=8)
    columns = {(t, c): {r[i] for r in rows} - {None} for t, rows in data.items() for i, c in enumerate(frames[t].columns)}
    keys = {(t, frames[t].columns[k[0]]) for t, rows in data.items() for k in brute_keys(rows, len(frames[t].columns), 1)}
    want = {(c, p) for p in keys for c, v in columns.items() if c != p and v and v <= columns[p]}
    assert {((i.child.table, *i.child.names), (i.parent.table, *i.parent.names)) for i in found.inclusions} == want and want
    for i in found.inclusions:
        assert i.child_distinct == len(columns[i.child.table, i.child.names[0]]) and i.one_to_one == ((i.child.table, i.child.names[0]) in keys)
    assert len(want) <= found.measured < found.candidates


def test_a_sample_never_refutes_an_inclusion(spark):
    big = spark.range(20_000).select(F.col("id").alias("p"), (F.col("id") * 7 % 1000).alias("c"), (F.col("id") + 1).alias("q"))
    cols = {D.Columns("t", (c,)): big.select(c).distinct().count() for c in "pcq"}
    s = D.bottom_samples({"t": big}, cols, k=64)
    p, c, q = (s[D.Columns("t", (x,))] for x in "pcq")
    assert not c.refutes(p) and p.refutes(c)
    assert all(20 < len(x.hashes) < 150 for x in (p, q)) and all(len(x.hashes) < 150 for x in s.values())
    one_off = D.included({"t": big}, [(D.Columns("t", ("q",)), D.Columns("t", ("p",)))])
    assert one_off.inclusions == []  # q has one value that p lacks


def test_one_to_one_links_and_composite_links(spark):
    orders = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    notes = spark.createDataFrame([(1, "n"), (3, "m")], "order_id bigint, note string")
    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "o int, line int")
    scans = spark.createDataFrame([(1, 2, 5), (1, 2, 6), (2, 1, 7), (2, None, 8)], "so int, sl int, x int")
    t = {"orders": orders, "notes": notes, "lines": lines, "scans": scans}
    got = {(i.child, i.parent): i for i in D.inclusions(t).inclusions}
    assert got[D.Columns("notes", ("order_id",)), D.Columns("orders", ("id",))].one_to_one
    wide = D.composite_inclusions(t)
    links = {(i.child, i.parent): i for i in wide.inclusions}
    link = links[D.Columns("scans", ("so", "sl")), D.Columns("lines", ("o", "line"))]
    assert (link.child_distinct, link.parent_distinct, link.one_to_one) == (2, 3, False)
    assert (D.Columns("scans", ("sl", "so")), D.Columns("lines", ("o", "line"))) in links  # (2, 1) and (1, 2) both ways
    assert discover.link_rows(spark, wide).where("child_columns = 'so,sl'").count() == 1


def test_more_columns_than_bits(spark):
    """70 columns of one type: bit sets of two words."""
    df = spark.range(3).select(*[(F.col("id") + i % 2).alias(f"c{i}") for i in range(70)])
    cols = [D.Columns("t", (f"c{i}",)) for i in range(70)]
    pairs = [(cols[i], cols[j]) for i, j in ((0, 69), (0, 68), (63, 69), (61, 62))]
    n = D.meetings({"t": df}, pairs)
    assert [n.get(p, 0) for p in pairs] == [2, 3, 3, 2] and n[cols[69], cols[69]] == 3


def test_functional_dependencies(spark):
    rng = np.random.default_rng(1)
    zip_of = {z: (z % 7, None if z % 7 == 3 else f"r{z % 7 % 2}") for z in range(40)}
    rows = [(i, int(z), *zip_of[int(z)], int(rng.integers(0, 3)), 1) for i, z in enumerate(rng.integers(0, 40, 900))]
    df = spark.createDataFrame(rows, "id int, zip int, city int, region string, x int, const int").repartition(3)
    cols = df.columns

    def holds(a, b):
        pairs = {(r[a], r[b]) for r in rows}
        return len({p[0] for p in pairs}) == len(pairs)

    want = sorted((cols[a], cols[b]) for a in range(1, 5) for b in range(5) if a != b and b != 5 and holds(a, b))
    assert D.functional_dependencies(df, groups=10) == want == [("city", "region"), ("zip", "city"), ("zip", "region")]
    dims = {d.key_column: d for d in D.propose_dimensions(df, "wide")}
    assert dims["zip"].attribute_columns == ("city", "region") and set(dims) == {"zip", "city"}
    built = build_dimension(dims["zip"], {"wide": df})
    assert built.count() == built.select("zip").distinct().count() == len({r[1] for r in rows})


def test_long_texts_are_grouped_by_their_hash(spark):
    a, b = "a" * 5000, "a" * 4999 + "b"
    df = spark.createDataFrame([(a, "x"), (b, "x,y"), (a, "z"), ("a" * 32, "w")], "`long,text` string, short string")
    assert profile.key_tests({"t": df}, [("t", ["long,text"]), ("t", ["short"]), ("t", ["long,text", "short"])]) == [False, True, True]
    plan = profile._key_report({"t": df}, [("t", ["long,text"])])._jdf.queryExecution().toString()
    assert "sha2" in plan
    got = discover.key_columns({"t": df}).collect()
    assert [(r["key_columns"], r["ordinal"], r["column_name"]) for r in got] == [("short", 1, "short")]
    both = discover.key_columns({"t": df.union(spark.createDataFrame([(b, "x")], df.schema))}).collect()
    assert [(r["ordinal"], r["column_name"]) for r in both] == [(1, "long,text"), (2, "short")]  # a comma in a name stays
    got = profile.profile_columns(df.withColumnRenamed("long,text", "t")).where("column_name = 't'").first()
    assert (got["row_count"], got["null_count"], got["distinct_count"]) == (4, 0, 3)
