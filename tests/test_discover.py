"""Key / FK discovery and proposals (P5, P8, P9) on the small test tables."""

import duckdb
import pytest

from starmart.operators import discover, profile
from starmart.operators.facts import build_fact
from starmart.sources.tables import load_tables

from conftest import SF_SMALL

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def tables(spark):
    return load_tables(spark, SF_SMALL)


def test_discovered_keys(tables):
    keys = {(r.table_name, r.key_columns) for r in discover.discover_keys(tables, NAMES).where("is_key").collect()}
    assert {("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"),
            ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")} <= keys
    # (l_orderkey, l_linenumber) is not unique in this data: never reported as a key
    assert ("lineitem", "l_orderkey,l_linenumber") not in keys
    assert not any(t == "lineitem" and "," not in k for t, k in keys)


def test_shortlist_pairs_only_without_single_key(tables):
    short = profile.shortlist_keys_many(tables, ["orders", "lineitem"])
    assert short["orders"] == [("o_orderkey",)]
    assert all(len(s) == 2 for s in short["lineitem"])


def test_foreign_keys_coverage_matches_sql(tables):
    fks = discover.foreign_keys(tables, [("orders", "o_custkey", "customer", "c_custkey"),
                                         ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
                                         ("orders", "o_orderstatus", "customer", "c_custkey")])
    got = {(r.child_column, r.parent_column): (r.child_distinct, r.matched_distinct, r.parent_distinct)
           for r in fks.collect()}
    con = duckdb.connect()
    for n in ("orders", "customer", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF_SMALL}/{n}.parquet')")
    want = con.execute("""
        SELECT (SELECT COUNT(DISTINCT o_custkey) FROM orders),
               (SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
               (SELECT COUNT(DISTINCT c_custkey) FROM customer)""").fetchone()
    assert got[("o_custkey", "c_custkey")] == tuple(want)
    # a string column never pairs with an integer key
    assert ("o_orderstatus", "c_custkey") not in got


def test_star_candidates_rank_name_match_first(tables):
    rows = discover.star_candidates(tables, names=NAMES).collect()
    best = {(r.fact_table, r.fact_key): r.dimension_table for r in rows if r.rank == 1}
    assert best[("orders", "o_custkey")] == "customer"
    assert best[("lineitem", "l_partkey")] == "part"
    assert best[("lineitem", "l_suppkey")] == "supplier"


def test_proposal_builds_and_matches_brute_force(spark, tables):
    specs = discover.propose_marts(tables, NAMES)
    best = specs[0]
    fact = best.facts[0]
    assert best.mart_name == "lineitem_mart"
    assert set(fact.dimension_keys) == {"l_orderkey", "l_partkey", "l_suppkey"}
    assert "l_linenumber" not in fact.dimension_keys  # weak accidental link dropped
    got = {tuple(r[:3]): (round(r.sum_l_quantity, 6), r.row_count) for r in build_fact(fact, tables, best).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF_SMALL}/lineitem.parquet')")
    want = {tuple(r[:3]): (round(r[3], 6), r[4]) for r in con.execute(
        "SELECT l_orderkey, l_partkey, l_suppkey, SUM(l_quantity), COUNT(*) FROM lineitem GROUP BY 1, 2, 3").fetchall()}
    assert got == want
