"""The sales mart over the driver's TPC-H-style tables.

Money sums go through DECIMAL inside the metric expression so that the result
is exact (independent of summation order) before it is conformed to DOUBLE.
"""

from __future__ import annotations

from starmart.spec import Dimension, Fact, Join, MartSpec, Metric

REVENUE = Metric("total_revenue", "sum", "o_totalprice",
                 expression="SUM(CAST(o_totalprice AS DECIMAL(18,2)))", additive=True)
ORDER_COUNT = Metric("order_count", "count", "o_orderkey")

DIM_CUSTOMER = Dimension("dim_customer", "customer", "c_custkey", ("c_name", "c_mktsegment", "c_nationkey"))
DIM_CUSTOMER_GEO = Dimension(
    "dim_customer_geo", "customer", "c_custkey", ("n_name", "r_name"),
    joins=(Join("nation", "c_nationkey", "n_nationkey"), Join("region", "n_regionkey", "r_regionkey")),
)
DIM_PART = Dimension("dim_part", "part", "p_partkey", ("p_name", "p_brand", "p_type", "p_size"))
DIM_SUPPLIER = Dimension("dim_supplier", "supplier", "s_suppkey", ("s_name", "s_nationkey"))
DIM_USER = Dimension("dim_user", "events", "user_id", (), dedupe=True)

FACT_ORDERS = Fact(
    "fact_orders", ("orders",), (REVENUE, ORDER_COUNT), ("o_custkey",), grain="one row per customer",
    key_map={"o_custkey": ("dim_customer", "dim_customer_geo")}, time_column="o_orderdate",
)
FACT_ORDERS_MONTHLY = Fact(
    "fact_orders_monthly", ("orders",), (REVENUE, ORDER_COUNT), ("o_custkey",),
    grain="one row per customer and month",
    key_map={"o_custkey": ("dim_customer", "dim_customer_geo")},
    time_column="o_orderdate", time_grain="monthly",
)
FACT_LINEITEM = Fact(
    "fact_lineitem", ("lineitem",),
    (
        Metric("net_revenue", "sum", "l_extendedprice",
               expression="SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))",
               additive=True),
        Metric("line_count", "count"),
    ),
    ("l_suppkey", "l_returnflag"), grain="one row per supplier and return flag",
    key_map={"l_suppkey": "dim_supplier"}, time_column="l_shipdate",
)
FACT_EVENTS = Fact(
    "fact_events", ("events",),
    (
        Metric("total_value", "sum", "value", expression="SUM(CAST(value AS DECIMAL(18,2)))", additive=True),
        Metric("event_count", "count"),
        Metric("first_ts", "min", "ts"),
        Metric("last_ts", "max", "ts"),
    ),
    ("user_id", "event_type"), grain="one row per user and event type",
    key_map={"user_id": "dim_user"}, time_column="ts",
)

SALES_MART = MartSpec(
    "sales",
    facts=(FACT_ORDERS, FACT_ORDERS_MONTHLY, FACT_LINEITEM, FACT_EVENTS),
    dimensions=(DIM_CUSTOMER, DIM_CUSTOMER_GEO, DIM_PART, DIM_SUPPLIER, DIM_USER),
    description="Orders, line items and events by customer, supplier, user and period.",
)
