"""Property-based tests: random small tables (nulls, duplicates, hot keys)
against plain-Python brute force."""

from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from starmart.operators import checks
from starmart.operators.facts import build_fact, build_fact_states, fact_rows
from starmart.operators.star import rollup_states, star_rollup
from starmart.spec import Dimension, Fact, MartSpec, Metric
from starmart.streaming.incremental import merge_fact

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

# amounts with two decimals, so DECIMAL sums are exact and comparable
amount = st.one_of(st.none(), st.integers(-10_000, 10_000).map(lambda c: c / 100))
key = st.one_of(st.none(), st.integers(0, 4))
month = st.integers(1, 12)
rows_st = st.lists(st.tuples(key, month, amount), min_size=0, max_size=40)

METRICS = (
    Metric("total", "sum", "amount", expression="SUM(CAST(amount AS DECIMAL(18,2)))", additive=True),
    Metric("n_amount", "count", "amount"),
    Metric("n_rows", "count"),
    Metric("lo", "min", "amount"),
    Metric("hi", "max", "amount"),
    Metric("n_months", "count_distinct", "month"),
)


def _df(spark, rows):
    return spark.createDataFrame(rows, "k int, month int, amount double")


def _expected(rows, keyf):
    groups = defaultdict(list)
    for r in rows:
        groups[keyf(r)].append(r)
    out = {}
    for g, rs in groups.items():
        vals = [a for _, _, a in rs if a is not None]
        total = float(sum(Decimal(str(a)) for a in vals)) if vals else None
        out[g] = (total, len(vals), len(rs), min(vals) if vals else None, max(vals) if vals else None,
                  len({m for _, m, _ in rs}))
    return out


def _got(df, keycols):
    names = [m.name for m in METRICS]
    return {tuple(r[c] for c in keycols) if len(keycols) != 1 else r[keycols[0]]:
            tuple(r[n] for n in names) for r in df.collect()}


@SETTINGS
@given(rows=rows_st)
def test_fact_matches_brute_force(spark, rows):
    fact = Fact("f", ("t",), METRICS, ("k",))
    got = _got(build_fact(fact, {"t": _df(spark, rows)}), ["k"])
    assert got == _expected(rows, lambda r: r[0])


@SETTINGS
@given(rows=rows_st, segs=st.lists(st.sampled_from(["a", "b", "c"]), min_size=5, max_size=5))
def test_star_plans_match_brute_force(spark, rows, segs):
    """Broadcast plan and pre-aggregate + shuffle plan both equal brute force,
    including fact keys without a dimension row (NULL segment) and NULL keys."""
    dim = spark.createDataFrame([(i, segs[i]) for i in range(4)], "k int, seg string")  # key 4 has no row
    fact = Fact("f", ("t",), METRICS, ("k",), key_map={"k": "d"})
    spec = MartSpec("m", (fact,), (Dimension("d", "dim", "k", ("seg",)),))
    tables = {"t": _df(spark, rows), "dim": dim}
    seg_of = {i: segs[i] for i in range(4)}
    want = _expected(rows, lambda r: seg_of.get(r[0]))
    for bound in (10**9, 0):
        assert _got(star_rollup(fact, tables, spec, ["seg"], broadcast_rows=bound), ["seg"]) == want


@SETTINGS
@given(rows=rows_st)
def test_rollup_states_exact(spark, rows):
    t = {"t": _df(spark, rows)}
    fine = Fact("f", ("t",), METRICS, ("k", "month"))
    states = build_fact_states(fine, t)
    got = _got(rollup_states(states, fine, keys=("k",)), ["k"])
    assert got == _expected(rows, lambda r: r[0])


@SETTINGS
@given(old=rows_st, new=rows_st)
def test_incremental_merge_equals_rebuild(spark, old, new):
    additive = tuple(m for m in METRICS if m.aggregation != "count_distinct")
    fact = Fact("f", ("t",), additive, ("k",))
    a, b = {"t": _df(spark, old)}, {"t": _df(spark, new)}
    merged = merge_fact(build_fact(fact, a), build_fact(fact, b), fact, fact_rows(fact, b))
    full = build_fact(fact, {"t": _df(spark, old + new)})
    assert sorted(map(tuple, merged.collect()), key=lambda t: (t[0] is None, t[0])) == \
        sorted(map(tuple, full.select(*merged.columns).collect()), key=lambda t: (t[0] is None, t[0]))


@SETTINGS
@given(child=st.lists(key, max_size=40), parent=st.lists(st.integers(0, 4), max_size=6))
def test_relationships_match_brute_force(spark, child, parent):
    c = spark.createDataFrame([(i, k) for i, k in enumerate(child)], "id int, fk int")
    p = spark.createDataFrame([(k,) for k in parent], "pk int")
    keys = set(parent)
    orphans = [i for i, k in enumerate(child) if k is not None and k not in keys]
    for bound in (10**9, 0):
        rep = checks.relationship_violations(c, "fk", p, "pk", broadcast_rows=bound).first()
        assert rep.n_violations == len(orphans) and rep.passed == (not orphans)
        got = sorted(r.id for r in checks.orphan_rows(c, "fk", p, "pk", broadcast_rows=bound).collect())
        assert got == orphans
    dup_keys = sum(1 for k in keys if parent.count(k) > 1)
    assert checks.unique_violations(p, "pk").first().n_violations == dup_keys


@SETTINGS
@given(keys=st.lists(st.one_of(st.none(), st.integers(0, 6), st.just(3)), max_size=60),
       right_keys=st.sets(st.integers(0, 8), max_size=8),
       how=st.sampled_from(["left", "inner", "left_semi", "left_anti"]))
def test_skew_split_join_matches_join(spark, keys, right_keys, how):
    from starmart.plans.joins import skew_split_join
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int")
    right = spark.createDataFrame([(k, k * 10) for k in sorted(right_keys)], "rk int, v int")
    got = skew_split_join(left, right, ["k"], ["rk"], how, fraction=0.1)
    want = left.join(right, left["k"] == right["rk"], how)
    norm = lambda df: sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    key = lambda t: tuple((v is None, v) for v in t)
    assert sorted(norm(got), key=key) == sorted(norm(want), key=key)
