"""Registered queries: one per inventory item, each ``(spark, sf_dir) -> DataFrame``.

Every query goes through the library's operators (spec -> lazy DataFrames),
reads the whole tables under ``sf_dir`` and returns a DataFrame whose column
names match the DuckDB oracle in :mod:`starmart.oracle`.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.operators import checks, dates, dependencies, discover, profile
from starmart.operators.dims import build_dimension
from starmart.operators.facts import build_fact, build_fact_states, fact_rows
from starmart.operators.star import answer, rollup_states, star_rollup
from starmart.plans import tpch_mart as M
from starmart.session import scratch_path
from starmart.sinks.catalog import answer_from_mart, answer_published, facts_for, publish_to_catalog, rollup_published
from starmart.sinks.publish import publish_mart, write_table
from starmart.sources.tables import list_tables, load_tables, register_external_tables
from starmart.spec import Fact, Intent, Join, MartSpec, Metric
from starmart.streaming.corrections import correct_fact, write_correctable_fact
from starmart.streaming.incremental import merge_fact, refresh_fact, refresh_partitioned_fact, write_fact

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

# The given tables.
STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
GIVEN_TABLES = STAR_TABLES + ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def query(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _tables(spark: SparkSession, sf_dir: str):
    return load_tables(spark, sf_dir)


# -- P: profiling / catalog ---------------------------------------------------

@query("catalog_columns")
def catalog_columns(spark, sf_dir):
    return profile.catalog_columns(_tables(spark, sf_dir), ["customer", "events", "orders"])


@query("source_catalog")
def source_catalog(spark, sf_dir):
    """Per-column source metadata with row counts and discovered keys."""
    return profile.describe_sources(_tables(spark, sf_dir), GIVEN_TABLES, detect_keys=True)


@query("catalog_row_counts")
def catalog_row_counts(spark, sf_dir):
    return profile.row_counts(_tables(spark, sf_dir), GIVEN_TABLES)


@query("catalog_tables")
def catalog_tables(spark, sf_dir):
    """P1: base tables of a catalog database (external tables over the given
    files), sorted; a view in the same database is not listed."""
    db = f"starmart_src_{uuid.uuid4().hex[:8]}"
    register_external_tables(spark, db, sf_dir, GIVEN_TABLES, scratch_path(spark, "catalog") + "/" + db)
    spark.sql(f"CREATE VIEW `{db}`.`recent_orders` AS SELECT * FROM `{db}`.`orders` WHERE o_orderdate >= '1998-01-01'")
    return list_tables(spark, db)


@query("catalog_stats_row_counts")
def catalog_stats_row_counts(spark, sf_dir):
    """P4: row counts read from catalog statistics (external tables over the
    given files; ANALYZE collects the statistics, then no scan is needed)."""
    db = f"starmart_src_{uuid.uuid4().hex[:8]}"
    register_external_tables(spark, db, sf_dir, GIVEN_TABLES, scratch_path(spark, "catalog") + "/" + db)
    return profile.stats_row_counts(spark, GIVEN_TABLES, db, analyze=True)


@query("profile_columns")
def profile_columns(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return profile.profile_columns(t["orders"], table_name="orders").drop("table_name")


@query("sample_values")
def sample_values(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return profile.sample_values(t["customer"], t["customer"].columns, k=5)


@query("candidate_keys")
def candidate_keys(spark, sf_dir):
    return profile.candidate_keys(_tables(spark, sf_dir), [
        ("orders", ["o_orderkey"]), ("orders", ["o_custkey"]), ("customer", ["c_custkey"]),
        ("lineitem", ["l_orderkey", "l_linenumber"]),
    ])


@query("foreign_keys")
def foreign_keys(spark, sf_dir):
    """Every type-compatible column against every discovered key of the star tables."""
    t = _tables(spark, sf_dir)
    return discover.discover_foreign_keys(t, STAR_TABLES).drop("child_coverage")


@query("key_columns")
def key_columns(spark, sf_dir):
    """Smallest keys of all given tables, single or composite, a row per key column."""
    return discover.key_columns(_tables(spark, sf_dir), GIVEN_TABLES)


@query("minimal_keys")
def minimal_keys(spark, sf_dir):
    """Every minimal key of up to three columns of all given tables, a row per key column."""
    return discover.minimal_key_columns(_tables(spark, sf_dir), GIVEN_TABLES)


@query("inclusions")
def inclusions(spark, sf_dir):
    """Every column of the given tables whose values all lie in a key, one-to-one links included."""
    return discover.link_rows(spark, dependencies.inclusions(_tables(spark, sf_dir), GIVEN_TABLES))


@query("composite_foreign_keys")
def composite_foreign_keys(spark, sf_dir):
    """Links to two-column keys: the given line items beside a table of parts and their
    suppliers derived from them, and one of suppliers, parts and return flags."""
    t = _tables(spark, sf_dir)
    offers = t["lineitem"].select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    shown = {"lineitem": t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"), "partsupp": offers, "part": t["part"],
             "conversations": t["conversations"].select("conv_id", "turn")}
    return discover.link_rows(spark, dependencies.composite_inclusions(shown))


WIDE_COLUMNS = ("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "r_name", "o_orderstatus", "o_orderpriority")


def _wide_orders(spark, sf_dir):
    """Orders with the attributes of their customers in every row, as a source without dimensions has them."""
    t = _tables(spark, sf_dir)
    fact = Fact("wide", ("orders",), (Metric("n", "count"),), joins=(
        Join("customer", "o_custkey", "c_custkey"), Join("nation", "c_nationkey", "n_nationkey"), Join("region", "n_regionkey", "r_regionkey")))
    return fact_rows(fact, t).select(*WIDE_COLUMNS)


@query("functional_dependencies")
def functional_dependencies(spark, sf_dir):
    """Which columns of the wide orders determine which others."""
    found = dependencies.functional_dependencies(_wide_orders(spark, sf_dir))
    return spark.createDataFrame(found, "determinant string, dependent string")


@query("dim_hidden_customer")
def dim_hidden_customer(spark, sf_dir):
    """The customer dimension, proposed from the wide orders' dependencies and built from them."""
    wide = _wide_orders(spark, sf_dir)
    dims = {d.key_column: d for d in dependencies.propose_dimensions(wide, "wide")}
    return build_dimension(dims["o_custkey"], {"wide": wide})


@query("star_candidates")
def star_candidates(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return discover.star_candidates(t, names=STAR_TABLES)


@query("proposed_fact")
def proposed_fact(spark, sf_dir):
    """The best discovered proposal, built: the re-aim of a model-made proposal.  Money
    columns are read as DECIMAL, so the proposed plain sums are exact."""
    t = dict(_tables(spark, sf_dir))
    for name in STAR_TABLES:
        money = [f.name for f in t[name].schema.fields if f.dataType.typeName() == "double"]
        t[name] = t[name].withColumns({c: F.col(c).cast("decimal(18,2)") for c in money})
    best = discover.propose_marts(t, STAR_TABLES)[0]
    return build_fact(best.facts[0], t, best)


# -- D: dimensions ---------------------------------------------------------------

@query("dim_customer")
def dim_customer(spark, sf_dir):
    return build_dimension(M.DIM_CUSTOMER, _tables(spark, sf_dir))


@query("dim_part")
def dim_part(spark, sf_dir):
    return build_dimension(M.DIM_PART, _tables(spark, sf_dir))


@query("dim_supplier")
def dim_supplier(spark, sf_dir):
    return build_dimension(M.DIM_SUPPLIER, _tables(spark, sf_dir))


@query("dim_user_dedup")
def dim_user_dedup(spark, sf_dir):
    return build_dimension(M.DIM_USER, _tables(spark, sf_dir))


@query("dim_date")
def dim_date(spark, sf_dir):
    return dates.date_dimension(_tables(spark, sf_dir)["orders"], "o_orderdate")


# -- F: facts ------------------------------------------------------------------

def _orders_fact(name, metrics, keys=(), **kw) -> Fact:
    return Fact(name, ("orders",), metrics, keys, **kw)


@query("fact_orders")
def fact_orders(spark, sf_dir):
    return build_fact(M.FACT_ORDERS, _tables(spark, sf_dir), M.SALES_MART)


@query("fact_distinct_customers")
def fact_distinct_customers(spark, sf_dir):
    f = _orders_fact("fact_distinct_customers",
                     (Metric("distinct_customers", "count_distinct", "o_custkey"),), ("o_orderpriority",))
    return build_fact(f, _tables(spark, sf_dir))


@query("fact_avg")
def fact_avg(spark, sf_dir):
    f = _orders_fact("fact_avg", (Metric("avg_order_value", "avg", "o_totalprice",
                                         expression="ROUND(AVG(o_totalprice), 4)"),), ("o_orderstatus",))
    return build_fact(f, _tables(spark, sf_dir))


def _averages(spark, sf_dir, **kw):
    """Averages of a DECIMAL and of an integer column through a star join."""
    t = dict(_tables(spark, sf_dir))
    t["orders"] = t["orders"].withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))
    fact = replace(M.FACT_ORDERS, metrics=(Metric("avg_price", "avg", "price"), Metric("avg_customer", "avg", "o_custkey")))
    return star_rollup(fact, t, M.SALES_MART, ["r_name"], grain="yearly", **kw)


@query("fact_avg_star")
def fact_avg_star(spark, sf_dir):
    return _averages(spark, sf_dir)


@query("fact_avg_star_large_dims")
def fact_avg_star_large_dims(spark, sf_dir):
    return _averages(spark, sf_dir, broadcast_rows=0)


@query("fact_min_max")
def fact_min_max(spark, sf_dir):
    f = _orders_fact("fact_min_max", (
        Metric("first_order", "min", "o_orderdate"),
        Metric("largest_order", "max", "o_totalprice"),
        Metric("max_priority", "max", "o_orderpriority"),
    ), ("o_custkey",))
    return build_fact(f, _tables(spark, sf_dir))


@query("fact_lineitem_expr")
def fact_lineitem_expr(spark, sf_dir):
    return build_fact(M.FACT_LINEITEM, _tables(spark, sf_dir), M.SALES_MART)


@query("fact_status_degenerate")
def fact_status_degenerate(spark, sf_dir):
    f = _orders_fact("fact_status", (Metric("order_count", "count"),), ("o_custkey", "o_orderstatus"),
                     key_map={"o_custkey": "dim_customer"})
    return build_fact(f, _tables(spark, sf_dir), MartSpec("status", (f,), (M.DIM_CUSTOMER,)))


@query("fact_grand_total")
def fact_grand_total(spark, sf_dir):
    f = _orders_fact("fact_grand_total", (M.REVENUE, Metric("order_count", "count")))
    return build_fact(f, _tables(spark, sf_dir))


@query("fact_factless")
def fact_factless(spark, sf_dir):
    f = Fact("fact_factless", ("lineitem",), (), ("l_partkey", "l_suppkey"))
    return build_fact(f, _tables(spark, sf_dir))


FACT_MULTI_SOURCE = Fact(
    "fact_multi_source", ("lineitem", "orders"),
    (Metric("quantity", "sum", "l_quantity", expression="SUM(CAST(l_quantity AS DECIMAL(18,2)))", additive=True),),
    ("o_custkey", "l_suppkey"),
    joins=(Join("orders", "l_orderkey", "o_orderkey"),),
)


@query("fact_multi_source")
def fact_multi_source(spark, sf_dir):
    return build_fact(FACT_MULTI_SOURCE, _tables(spark, sf_dir))


@query("fact_multi_source_large_side")
def fact_multi_source_large_side(spark, sf_dir):
    """J1 planned as when orders exceeds the broadcast bound: line items are
    aggregated to (l_orderkey, l_suppkey) states before the shuffle join."""
    return build_fact(FACT_MULTI_SOURCE, _tables(spark, sf_dir), broadcast_rows=0)


FACT_TWO_GRAINS = Fact(
    "fact_two_grains", ("lineitem", "orders"),
    (
        Metric("quantity", "sum", "l_quantity", expression="SUM(CAST(l_quantity AS DECIMAL(18,2)))", additive=True),
        Metric("line_count", "count"),
        M.REVENUE, M.ORDER_COUNT, Metric("avg_customer", "avg", "o_custkey"),
        Metric("cheapest_order", "min", "o_totalprice"),
    ),
    ("o_custkey",), joins=(Join("orders", "l_orderkey", "o_orderkey"),), key_map={"o_custkey": ("dim_customer", "dim_customer_geo")},
    time_column="o_orderdate", time_grain="yearly",
)


@query("fact_two_grains")
def fact_two_grains(spark, sf_dir):
    """J1 with metrics of two grains: quantities per line item, revenue per order; an
    order counts once however many lines it has."""
    return build_fact(FACT_TWO_GRAINS, _tables(spark, sf_dir))


@query("fact_two_grains_large_side")
def fact_two_grains_large_side(spark, sf_dir):
    return build_fact(FACT_TWO_GRAINS, _tables(spark, sf_dir), broadcast_rows=0)


@query("fact_order_lines")
def fact_order_lines(spark, sf_dir):
    """Per order, keyed on the line items' side of the join: the order's own price beside its lines."""
    fact = replace(FACT_TWO_GRAINS, dimension_keys=("l_orderkey",), key_map={}, time_grain=None, time_column=None)
    return build_fact(fact, _tables(spark, sf_dir)).drop("avg_customer", "cheapest_order")


@query("star_two_grains")
def star_two_grains(spark, sf_dir):
    """The same metrics by region of the customer and year, finished orders only."""
    spec = replace(M.SALES_MART, facts=(FACT_TWO_GRAINS,))
    return star_rollup(FACT_TWO_GRAINS, _tables(spark, sf_dir), spec, ["r_name"], filters={"o_orderstatus": "F"},
                       metrics=["quantity", "line_count", "total_revenue", "order_count"])


@query("intent_across_facts")
def intent_across_facts(spark, sf_dir):
    """An intent whose metrics no single fact holds: orders and line items drilled
    across by market segment and quarter."""
    lines = replace(FACT_TWO_GRAINS, name="fact_lines", metrics=FACT_TWO_GRAINS.metrics[:2])
    spec = replace(M.SALES_MART, facts=(M.FACT_ORDERS, lines))
    intent = Intent(("total_revenue", "quantity", "order_count"), ("c_mktsegment",), {"r_name": "EUROPE"}, "quarterly")
    return answer(intent, spec, _tables(spark, sf_dir))


# -- Q: filters, T: grains --------------------------------------------------------

ORDER_COUNT_ALL = Metric("order_count", "count")


@query("filter_equality")
def filter_equality(spark, sf_dir):
    f = _orders_fact("fact_urgent_finished", (ORDER_COUNT_ALL,), ("o_custkey",),
                     filters={"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return build_fact(f, _tables(spark, sf_dir))


@query("filter_year_from")
def filter_year_from(spark, sf_dir):
    f = _orders_fact("fact_recent", (ORDER_COUNT_ALL,), ("o_orderstatus",),
                     time_column="o_orderdate", filters={"year_from": "1998"})
    return build_fact(f, _tables(spark, sf_dir))


@query("grain_daily")
def grain_daily(spark, sf_dir):
    f = Fact("fact_events_daily", ("events",), (Metric("event_count", "count"),), ("event_type",),
             time_column="ts", time_grain="daily")
    return build_fact(f, _tables(spark, sf_dir))


@query("grain_weekly")
def grain_weekly(spark, sf_dir):
    f = _orders_fact("fact_orders_weekly", (ORDER_COUNT_ALL,), time_column="o_orderdate", time_grain="weekly")
    return build_fact(f, _tables(spark, sf_dir))


@query("grain_monthly")
def grain_monthly(spark, sf_dir):
    f = _orders_fact("fact_orders_monthly", (M.REVENUE,), ("o_custkey",),
                     time_column="o_orderdate", time_grain="monthly")
    return build_fact(f, _tables(spark, sf_dir))


@query("grain_quarterly")
def grain_quarterly(spark, sf_dir):
    f = _orders_fact("fact_orders_quarterly", (ORDER_COUNT_ALL,), time_column="o_orderdate", time_grain="quarterly")
    return build_fact(f, _tables(spark, sf_dir))


@query("grain_yearly")
def grain_yearly(spark, sf_dir):
    f = Fact("fact_lines_yearly", ("lineitem",), (Metric("line_count", "count"),), ("l_returnflag",),
             time_column="l_shipdate", time_grain="yearly")
    return build_fact(f, _tables(spark, sf_dir))


# -- J: star joins, F15 roll-up ---------------------------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue and order count by region, finished orders only."""
    return star_rollup(M.FACT_ORDERS, _tables(spark, sf_dir), M.SALES_MART, ["r_name"],
                       grain="monthly", filters={"o_orderstatus": "F"})


query("star_rollup")(flagship)


@query("star_rollup_large_dims")
def star_rollup_large_dims(spark, sf_dir):
    """The flagship planned as when no dimension fits the broadcast bound: the
    fact is pre-aggregated to (period, o_custkey) states before the joins."""
    return star_rollup(M.FACT_ORDERS, _tables(spark, sf_dir), M.SALES_MART, ["r_name"],
                       grain="monthly", filters={"o_orderstatus": "F"}, broadcast_rows=0)


@query("intent_segment_quarterly")
def intent_segment_quarterly(spark, sf_dir):
    """The same path driven by an intent: quarterly revenue by market segment from 1997."""
    intent = Intent(("total_revenue", "order_count"), ("c_mktsegment",),
                    filters={"year_from": "1997"}, time_granularity="quarterly")
    return answer(intent, M.SALES_MART, _tables(spark, sf_dir), fact_name="fact_orders")


@query("intent_region_filter")
def intent_region_filter(spark, sf_dir):
    """Yearly revenue by market segment for customers in ASIA: the filter names a
    dimension attribute, so it is applied to the dimension before the join."""
    intent = Intent(("total_revenue", "order_count"), ("c_mktsegment",), filters={"r_name": "ASIA"},
                    time_granularity="yearly")
    return answer(intent, M.SALES_MART, _tables(spark, sf_dir), fact_name="fact_orders")


@query("rollup_from_fact")
def rollup_from_fact(spark, sf_dir):
    monthly = _orders_fact("fact_orders_monthly", (
        M.REVENUE, ORDER_COUNT_ALL,
        Metric("smallest", "min", "o_totalprice"), Metric("largest", "max", "o_totalprice"),
    ), time_column="o_orderdate", time_grain="monthly")
    states = build_fact_states(monthly, _tables(spark, sf_dir))
    return rollup_states(states, monthly, keys=(), grain="yearly")


# -- C: checks ---------------------------------------------------------------------

@query("check_not_null")
def check_not_null(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return checks.not_null_counts(t["orders"], ["o_custkey", "o_totalprice"], "orders").select(
        "column_name", "n_violations")


@query("check_unique")
def check_unique(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return checks.unique_violations(t["customer"], "c_custkey", "customer").unionByName(
        checks.unique_violations(t["lineitem"], "l_orderkey", "lineitem")).select("column_name", "n_violations")


@query("check_unique_rows")
def check_unique_rows(spark, sf_dir):
    """The line items behind the failed uniqueness of (l_orderkey, l_linenumber)."""
    li = _tables(spark, sf_dir)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
    return checks.duplicate_key_rows(li, ["l_orderkey", "l_linenumber"])


@query("check_relationships")
def check_relationships(spark, sf_dir):
    t = _tables(spark, sf_dir)
    a = checks.relationship_violations(t["orders"], "o_custkey", t["customer"], "c_custkey", "orders")
    b = checks.relationship_violations(t["lineitem"], "l_partkey", t["part"], "p_partkey", "lineitem")
    return a.unionByName(b).select("column_name", "n_violations")


@query("check_relationships_large_parent")
def check_relationships_large_parent(spark, sf_dir):
    """C3 planned as when the parent keys exceed the broadcast bound: child keys
    are aggregated, then left-joined to the distinct parent keys."""
    t = _tables(spark, sf_dir)
    a = checks.relationship_violations(t["orders"], "o_custkey", t["customer"], "c_custkey", "orders",
                                       broadcast_rows=0)
    b = checks.relationship_violations(t["lineitem"], "l_partkey", t["part"], "p_partkey", "lineitem",
                                       broadcast_rows=0)
    return a.unionByName(b).select("column_name", "n_violations")


@query("check_relationships_orphans_large_parent")
def check_relationships_orphans_large_parent(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return checks.orphan_rows(t["documents"].select("doc_id", "lang"), "doc_id", t["labels"], "doc_id",
                              broadcast_rows=0).select("doc_id", "lang")


@query("check_relationships_orphans")
def check_relationships_orphans(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return checks.orphan_rows(t["documents"].select("doc_id", "lang"), "doc_id", t["labels"], "doc_id").select(
        "doc_id", "lang")


@query("check_accepted_values")
def check_accepted_values(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return checks.accepted_values_counts(t["orders"], {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "orders").select(
        "column_name", "n_violations")


@query("accepted_domains")
def accepted_domains(spark, sf_dir):
    dim = build_dimension(M.DIM_CUSTOMER, _tables(spark, sf_dir))
    return checks.accepted_domains(dim, list(M.DIM_CUSTOMER.attribute_columns))


CUSTOMER_ORDERS = MartSpec(
    "customer_orders",
    facts=(Fact("fact_orders", ("orders",), (M.REVENUE, M.ORDER_COUNT), ("o_custkey",),
                key_map={"o_custkey": "dim_customer"}),),
    dimensions=(M.DIM_CUSTOMER,),
)


@query("check_report")
def check_report(spark, sf_dir):
    return checks.check_report(CUSTOMER_ORDERS, _tables(spark, sf_dir))


@query("check_report_violations")
def check_report_violations(spark, sf_dir):
    """The same rules with a declared list of segments that the data does not keep to."""
    return checks.check_report(CUSTOMER_ORDERS, _tables(spark, sf_dir),
                               accepted={"dim_customer": {"c_mktsegment": ["BUILDING", "MACHINERY"]}})


# -- K: sinks ----------------------------------------------------------------------

@query("mart_roundtrip")
def mart_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "fact_orders")
    write_table(build_fact(M.FACT_ORDERS, _tables(spark, sf_dir), M.SALES_MART), path)
    return spark.read.parquet(path)


@query("mart_publish")
def mart_publish(spark, sf_dir):
    """Full publish (dimensions, facts, checks, pointer); returns the published fact."""
    mart = publish_mart(CUSTOMER_ORDERS, _tables(spark, sf_dir), scratch_path(spark, "mart"))
    return mart.read(spark)["fact_orders"]


GEO_MART = MartSpec(
    "geo",
    facts=(Fact("fact_orders_monthly", ("orders",), (M.REVENUE, M.ORDER_COUNT), ("o_custkey",),
                key_map={"o_custkey": "dim_customer_geo"}, time_column="o_orderdate", time_grain="monthly"),),
    dimensions=(M.DIM_CUSTOMER_GEO,),
)


@query("mart_catalog_rollup")
def mart_catalog_rollup(spark, sf_dir):
    """Publish a monthly fact and its snowflaked dimension as bucketed catalog
    tables, then answer quarterly revenue by region from the published mart."""
    t = _tables(spark, sf_dir)
    db = f"starmart_geo_{uuid.uuid4().hex[:8]}"
    publish_to_catalog(GEO_MART, t, db, f"{scratch_path(spark, 'warehouse')}/{db}", buckets=16)
    return rollup_published(spark, GEO_MART, db, "fact_orders_monthly", ["r_name"], grain="quarterly", tables=t)


@query("mart_republished")
def mart_republished(spark, sf_dir):
    """Publish the orders before 1996, then all orders: the mart moves to the second run at
    once; the first stays readable by its run."""
    t = dict(_tables(spark, sf_dir))
    db = f"starmart_geo_{uuid.uuid4().hex[:8]}"
    location = f"{scratch_path(spark, 'warehouse')}/{db}"
    early = {**t, "orders": t["orders"].where("o_orderdate < DATE '1996-01-01'")}
    for run, tables in (("early", early), ("whole", t)):
        publish_to_catalog(GEO_MART, tables, db, location, buckets=4, run_id=run)
    runs = [rollup_published(spark, GEO_MART, db, "fact_orders_monthly", ["r_name"], grain="yearly", tables=t, run_id=run)
            .withColumn("run", F.lit(run or "current")) for run in ("early", None)]
    return runs[0].unionByName(runs[1])


SEGMENT_GEO_MART = MartSpec(
    "segment_geo",
    facts=(Fact("fact_orders_monthly", ("orders",), (M.REVENUE, M.ORDER_COUNT), ("o_custkey",),
                key_map={"o_custkey": ("dim_customer", "dim_customer_geo")},
                time_column="o_orderdate", time_grain="monthly"),),
    dimensions=(M.DIM_CUSTOMER, M.DIM_CUSTOMER_GEO),
)


@query("intent_published")
def intent_published(spark, sf_dir):
    """Publish once (bucketed catalog tables), then answer an intent from the
    published mart: quarterly revenue by region for AUTOMOBILE customers from
    1996 (one filter on a dimension attribute, one on the period)."""
    t = _tables(spark, sf_dir)
    db = f"starmart_seg_{uuid.uuid4().hex[:8]}"
    publish_to_catalog(SEGMENT_GEO_MART, t, db, f"{scratch_path(spark, 'warehouse')}/{db}", buckets=16)
    intent = Intent(("total_revenue", "order_count"), ("r_name",),
                    filters={"c_mktsegment": "AUTOMOBILE", "year_from": "1996"}, time_granularity="quarterly")
    return answer_published(spark, intent, SEGMENT_GEO_MART, db, "fact_orders_monthly", tables=t)


NAVIGATED_MART = MartSpec(
    "navigated",
    facts=(
        Fact("by_customer_daily", ("orders",), (M.REVENUE, M.ORDER_COUNT, Metric("priorities", "count_distinct", "o_orderpriority")), ("o_custkey", "o_orderpriority"),
             key_map={"o_custkey": ("dim_customer", "dim_customer_geo")}, time_column="o_orderdate", time_grain="daily"),
        Fact("by_customer_yearly", ("orders",), (M.REVENUE, M.ORDER_COUNT), ("o_custkey",), key_map={"o_custkey": ("dim_customer", "dim_customer_geo")},
             time_column="o_orderdate", time_grain="yearly"),
        Fact("by_priority_yearly", ("orders",), (M.REVENUE,), ("o_orderpriority",), time_column="o_orderdate", time_grain="yearly"),
        Fact("finished_yearly", ("orders",), (M.REVENUE, M.ORDER_COUNT), ("o_custkey",), key_map={"o_custkey": ("dim_customer", "dim_customer_geo")},
             time_column="o_orderdate", time_grain="yearly", filters={"o_orderstatus": "F"}),
    ),
    dimensions=(M.DIM_CUSTOMER, M.DIM_CUSTOMER_GEO),
)


@query("intent_navigated")
def intent_navigated(spark, sf_dir):
    """Intents answered from whichever published fact is the smallest that can: revenue
    by priority, by region, by region of finished orders, and distinct priorities by quarter."""
    t = _tables(spark, sf_dir)
    db = f"starmart_nav_{uuid.uuid4().hex[:8]}"
    publish_to_catalog(NAVIGATED_MART, t, db, f"{scratch_path(spark, 'warehouse')}/{db}", buckets=4, check=False)
    asked = [
        (Intent(("total_revenue",), ("o_orderpriority",), time_granularity="yearly"), "by_priority_yearly"),
        (Intent(("total_revenue",), ("r_name",), {"year_from": "1995"}, "yearly"), "by_customer_yearly"),
        (Intent(("total_revenue",), ("r_name",), {"o_orderstatus": "F"}, "yearly"), "finished_yearly"),
        (Intent(("priorities",), ("r_name",), time_granularity="quarterly"), "by_customer_daily"),
    ]
    out = None
    for intent, _ in asked:
        fact = facts_for(spark, intent, NAVIGATED_MART, db)[0]
        part = answer_from_mart(spark, intent, NAVIGATED_MART, db, t)
        part = part.select(F.lit(fact).alias("fact"), "period", F.col(intent.required_dimensions[0]).alias("label"), F.col(intent.required_metrics[0]).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


INCREMENTAL_SPLIT = "2024-01-16"


@query("fact_incremental")
def fact_incremental(spark, sf_dir):
    t = _tables(spark, sf_dir)
    events = t["events"]
    cut = F.lit(INCREMENTAL_SPLIT).cast("timestamp_ntz")
    root = scratch_path(spark, "fact_events")
    base = build_fact(M.FACT_EVENTS, {"events": events.where(F.col("ts") < cut)}, M.SALES_MART)
    write_table(base, f"{root}/v=0")
    later = ~F.coalesce(F.col("ts") < cut, F.lit(False))
    return refresh_fact(M.FACT_EVENTS, f"{root}/v=0", {"events": events.where(later)},
                        f"{root}/v=1", M.SALES_MART)


FACT_EVENTS_DAILY = Fact(
    "fact_events_daily", ("events",), M.FACT_EVENTS.metrics, ("event_type",),
    time_column="ts", time_grain="daily",
)


@query("fact_incremental_partitioned")
def fact_incremental_partitioned(spark, sf_dir):
    """Daily events fact published partitioned by period; the refresh rewrites
    only the days the new rows touch (the split falls inside a day, so that day
    is merged from both sides)."""
    events = _tables(spark, sf_dir)["events"]
    cut = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    root = scratch_path(spark, "fact_events_daily")
    write_table(build_fact(FACT_EVENTS_DAILY, {"events": events.where(F.col("ts") < cut)}), f"{root}/fact",
                partition_by=["period"])
    later = ~F.coalesce(F.col("ts") < cut, F.lit(False))
    refresh_partitioned_fact(FACT_EVENTS_DAILY, f"{root}/fact", {"events": events.where(later)}, f"{root}/staging")
    return spark.read.parquet(f"{root}/fact")


FACT_EVENTS_AVG = Fact(
    "fact_events_avg", ("events",), (Metric("avg_user", "avg", "user_id"), Metric("event_count", "count")), ("event_type",),
    time_column="ts", time_grain="daily",
)


@query("fact_incremental_avg")
def fact_incremental_avg(spark, sf_dir):
    """An average kept up to date: its sum and count are stored beside it."""
    events = _tables(spark, sf_dir)["events"]
    old = F.col("event_id") % 3 == 0
    root = scratch_path(spark, "fact_events_avg")
    first = build_fact(FACT_EVENTS_AVG, {"events": events.where(old)}, states=True)
    write_table(first, f"{root}/fact", partition_by=["period"])
    refresh_partitioned_fact(FACT_EVENTS_AVG, f"{root}/fact", {"events": events.where(~old)}, f"{root}/staging")
    return spark.read.parquet(f"{root}/fact").select("period", "event_type", "avg_user", "event_count")


@query("rollup_published_avg")
def rollup_published_avg(spark, sf_dir):
    """Averages per region and year from a published monthly fact."""
    t = dict(_tables(spark, sf_dir))
    t["orders"] = t["orders"].withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))
    fact = replace(M.FACT_ORDERS, metrics=(Metric("avg_price", "avg", "price"), Metric("avg_customer", "avg", "o_custkey")),
                   time_column="o_orderdate", time_grain="monthly")
    spec = replace(M.SALES_MART, facts=(fact,), dimensions=(M.DIM_CUSTOMER, M.DIM_CUSTOMER_GEO))
    db = f"starmart_avg_{uuid.uuid4().hex[:8]}"
    publish_to_catalog(spec, t, db, scratch_path(spark, "avg") + "/" + db, buckets=8)
    return rollup_published(spark, spec, db, fact.name, ["r_name"], grain="yearly", tables=t)


FACT_DISTINCT = Fact(
    "fact_distinct", ("lineitem", "orders"),
    (Metric("distinct_parts", "count_distinct", "l_partkey"), Metric("line_count", "count"),
     Metric("distinct_priorities", "count_distinct", "o_orderpriority"), Metric("distinct_orders", "count_distinct", "o_orderkey")),
    ("o_custkey",), joins=(Join("orders", "l_orderkey", "o_orderkey"),), key_map={"o_custkey": "dim_customer_geo"},
    time_column="o_orderdate", time_grain="monthly",
)


@query("rollup_published_distinct")
def rollup_published_distinct(spark, sf_dir):
    """Exact distinct parts, priorities and orders per region and year, from the sets
    published beside a monthly fact."""
    t = _tables(spark, sf_dir)
    spec = MartSpec("distinct", (FACT_DISTINCT,), (M.DIM_CUSTOMER_GEO,))
    db = f"starmart_distinct_{uuid.uuid4().hex[:8]}"
    publish_to_catalog(spec, t, db, scratch_path(spark, "distinct") + "/" + db, buckets=8)
    return rollup_published(spark, spec, db, FACT_DISTINCT.name, ["r_name"], grain="yearly", tables=t)


FACT_EVENTS_DISTINCT = Fact(
    "fact_events_distinct", ("events",),
    (Metric("distinct_users", "count_distinct", "user_id"), Metric("distinct_props", "count_distinct", "props"), Metric("event_count", "count")), ("event_type",),
)


@query("fact_incremental_distinct")
def fact_incremental_distinct(spark, sf_dir):
    """Exact distinct counts kept up to date over two refreshes: users are numbers, the
    texts of props get ids that grow with them."""
    events = _tables(spark, sf_dir)["events"]
    root, third = scratch_path(spark, "fact_events_distinct"), F.col("event_id") % 3
    write_fact(FACT_EVENTS_DISTINCT, {"events": events.where(third == 0)}, f"{root}/a")
    refresh_fact(FACT_EVENTS_DISTINCT, f"{root}/a", {"events": events.where(third == 1)}, f"{root}/b")
    return refresh_fact(FACT_EVENTS_DISTINCT, f"{root}/b", {"events": events.where(third == 2)}, f"{root}/c")


FACT_EVENTS_CORRECTED = replace(FACT_EVENTS_DAILY, name="fact_events_corrected", metrics=(
    *FACT_EVENTS_DAILY.metrics, Metric("avg_user", "avg", "user_id"), Metric("distinct_users", "count_distinct", "user_id")))


@query("fact_corrected")
def fact_corrected(spark, sf_dir):
    """A third of the events is taken back (with it whole days and the extremes of
    others), some of it comes in again under another type."""
    events = _tables(spark, sf_dir)["events"]
    gone = (F.col("event_id") % 3 == 0) | (F.dayofmonth("ts") == 7)
    moved = events.where(gone & (F.col("event_id") % 2 == 0)).withColumn("event_type", F.lit("corrected"))
    root = scratch_path(spark, "fact_events_corrected")
    write_correctable_fact(FACT_EVENTS_CORRECTED, {"events": events}, f"{root}/a")
    after = {"events": events.where(~gone).unionByName(moved)}
    out = correct_fact(FACT_EVENTS_CORRECTED, f"{root}/a", {"events": moved}, {"events": events.where(gone)}, after, f"{root}/b")
    return out.select("period", "event_type", *[m.name for m in FACT_EVENTS_CORRECTED.metrics])


@query("check_refresh")
def check_refresh(spark, sf_dir):
    """The checks of a refresh whose orders partly lack a customer or a price, made on
    the touched groups alone: the verdicts of the full report on the merged fact."""
    t = _tables(spark, sf_dir)
    key, old = F.col("o_orderkey"), F.col("o_orderkey") % 3 != 0
    orders = t["orders"].withColumn("o_custkey", F.when(~old & (key % 50 == 0), key + 100_000_000).when(~old & (key % 77 == 0), None).otherwise(F.col("o_custkey")))
    orders = orders.withColumn("o_totalprice", F.when(old | (key % 5 != 0), F.col("o_totalprice")))
    spec, dims = CUSTOMER_ORDERS, {"dim_customer": build_dimension(M.DIM_CUSTOMER, t)}
    fact = spec.facts[0]
    current = write_fact(fact, {**t, "orders": orders.where(old)}, scratch_path(spark, "fact_orders_checked"), spec)
    delta = build_fact(fact, {**t, "orders": orders.where(~old)}, spec)
    return checks.refresh_report(fact, spec, delta, current, dims)


@query("fact_incremental_null_period")
def fact_incremental_null_period(spark, sf_dir):
    """The same refresh where every seventh event has no time: rows without a
    period are merged like those of any other."""
    events = _tables(spark, sf_dir)["events"]
    events = events.withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    old = F.col("event_id") % 2 == 0
    root = scratch_path(spark, "fact_events_null")
    write_table(build_fact(FACT_EVENTS_DAILY, {"events": events.where(old)}), f"{root}/fact", partition_by=["period"])
    refresh_partitioned_fact(FACT_EVENTS_DAILY, f"{root}/fact", {"events": events.where(~old)}, f"{root}/staging")
    return spark.read.parquet(f"{root}/fact")


__all__ = ["registry", "flagship", "merge_fact"]
