"""DuckDB oracle SQL for each registered query (same column names).

The texts run on views named after the test tables.  Money sums go through
DECIMAL and back to DOUBLE so results do not depend on summation order.
"""

# Columns of the given tables that can be keys, as (name, type family).
_COLUMNS = {
    "region": "r_regionkey:int r_name:str",
    "nation": "n_nationkey:int n_name:str n_regionkey:int",
    "customer": "c_custkey:int c_name:str c_nationkey:int c_mktsegment:str",
    "supplier": "s_suppkey:int s_name:str s_nationkey:int",
    "part": "p_partkey:int p_name:str p_brand:str p_type:str p_size:int",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:str o_orderdate:ts o_orderpriority:str",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_returnflag:str l_linestatus:str l_shipdate:ts",
    "events": "event_id:int ts:ts user_id:int event_type:str props:str",
    "documents": "doc_id:int text:str lang:str source:str n_chars:int",
    "embeddings": "vec_id:int label:int",
    "pages": "page_id:int url:str html:str",
    "benchmark": "item_id:int text:str",
    "labels": "doc_id:int quality:int toxic:int",
    "conversations": "conv_id:int turn:int role:str text:str",
}
_COLUMNS = {t: [tuple(c.split(":")) for c in cs.split()] for t, cs in _COLUMNS.items()}
_STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_MEASURES = {"customer": ["c_acctbal"], "supplier": ["s_acctbal"], "part": ["p_retailprice"], "orders": ["o_totalprice"],
             "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]}


def _union_all(parts) -> str:
    return " UNION ALL ".join(parts)


def _key_test(table: str, columns: list[str]) -> str:
    """A row with is_key for a set of columns."""
    some_null = " OR ".join(f"{c} IS NULL" for c in columns)
    return (f"SELECT '{table}' AS t, '{','.join(columns)}' AS k, {len(columns)} AS w, (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {table}) d) "
            f"= (SELECT COUNT(*) FROM {table}) AND (SELECT COUNT(*) FROM {table} WHERE {some_null}) = 0 AS is_key")


_SINGLE_KEYS = _union_all(_key_test(t, [c]) for t, cs in _COLUMNS.items() for c, _ in cs)
_PAIR_KEYS = _union_all(_key_test(t, [a, b]) for t, cs in _COLUMNS.items() for i, (a, _) in enumerate(cs) for b, _ in cs[i + 1:])
_ROW_COUNTS = _union_all(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in _COLUMNS)

# Links between the star tables, from the distinct values of every column.
_LINKS = f"""
vals AS ({_union_all(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{f}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t in _STAR for c, f in _COLUMNS[t])}),
tests AS ({_union_all(_key_test(t, [c]) for t in _STAR for c, _ in _COLUMNS[t])}),
sizes AS (SELECT t, c, f, COUNT(*) AS d FROM vals GROUP BY t, c, f),
parents AS (SELECT s.* FROM sizes s JOIN tests k ON s.t = k.t AND s.c = k.k WHERE k.is_key),
children AS (SELECT s.* FROM sizes s JOIN tests k ON s.t = k.t AND s.c = k.k WHERE NOT k.is_key),
met AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, COUNT(*) AS m FROM vals a JOIN vals b ON a.f = b.f AND a.v = b.v
        WHERE (a.t, a.c) IN (SELECT t, c FROM children) AND (b.t, b.c) IN (SELECT t, c FROM parents) GROUP BY a.t, a.c, b.t, b.c),
links AS (SELECT c.t AS child_table, c.c AS child_column, p.t AS parent_table, p.c AS parent_column, c.d AS child_distinct,
                 COALESCE(m.m, 0) AS matched_distinct, p.d AS parent_distinct, CAST(COALESCE(m.m, 0) AS DOUBLE) / p.d AS parent_coverage
          FROM children c JOIN parents p ON c.f = p.f LEFT JOIN met m ON m.ct = c.t AND m.cc = c.c AND m.pt = p.t AND m.pc = p.c)
"""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["catalog_columns"] = """
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
       is_nullable = 'YES' AS is_nullable
FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ('customer', 'events', 'orders') ORDER BY table_name, ordinal_position
"""

ORACLE_SQL["catalog_row_counts"] = _ROW_COUNTS

ORACLE_SQL["profile_columns"] = _union_all(
    f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


ORACLE_SQL["sample_values"] = f"""
SELECT column_name, sample_value FROM (
  SELECT column_name, sample_value, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY sample_value) AS rn FROM (
    {_union_all(f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS STRING) AS sample_value FROM customer WHERE {c} IS NOT NULL"
                for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))}) a) b
WHERE rn <= 5
"""


ORACLE_SQL["candidate_keys"] = """
SELECT 'orders' AS table_name, 'o_orderkey' AS key_columns, COUNT(*) = COUNT(DISTINCT o_orderkey) AND COUNT(*) = COUNT(o_orderkey) AS is_key FROM orders
UNION ALL SELECT 'orders', 'o_custkey', COUNT(*) = COUNT(DISTINCT o_custkey) AND COUNT(*) = COUNT(o_custkey) FROM orders
UNION ALL SELECT 'customer', 'c_custkey', COUNT(*) = COUNT(DISTINCT c_custkey) AND COUNT(*) = COUNT(c_custkey) FROM customer
UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber', (SELECT COUNT(*) FROM lineitem) = (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d)
"""

ORACLE_SQL["foreign_keys"] = f"WITH {_LINKS} SELECT * FROM links"

ORACLE_SQL["star_candidates"] = f"""
WITH {_LINKS},
named AS (SELECT *, child_column = parent_column OR (regexp_extract(child_column, '^[^_]*_(.+)$', 1) <> ''
                 AND regexp_extract(child_column, '^[^_]*_(.+)$', 1) = regexp_extract(parent_column, '^[^_]*_(.+)$', 1)) AS name_match
          FROM links WHERE child_distinct > 0 AND matched_distinct = child_distinct),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY child_table, child_column ORDER BY name_match DESC, parent_coverage DESC,
                  parent_distinct, parent_table, parent_column) AS INTEGER) AS rank FROM named),
accepted AS (SELECT child_table, child_column FROM ranked WHERE rank = 1 AND (name_match OR parent_coverage >= 0.9) AND child_table <> parent_table),
numeric_columns AS ({_union_all(f"SELECT '{t}' AS t, '{c}' AS c" for t in _STAR for c in [*(c for c, f in _COLUMNS[t] if f == "int"), *_MEASURES.get(t, [])])}),
measures AS (SELECT n.t, CAST(COUNT(*) AS INTEGER) AS n_measures FROM numeric_columns n
             WHERE (n.t, n.c) NOT IN (SELECT child_table, child_column FROM accepted) AND (n.t, n.c) NOT IN (SELECT t, c FROM parents) GROUP BY n.t)
SELECT r.child_table AS fact_table, r.child_column AS fact_key, r.parent_table AS dimension_table, r.parent_column AS dimension_key,
       r.parent_coverage, r.name_match, r.rank, m.n_measures
FROM ranked r JOIN measures m ON m.t = r.child_table WHERE r.child_table <> r.parent_table
"""

ORACLE_SQL["key_columns"] = f"""
WITH singles AS ({_SINGLE_KEYS}), pairs AS ({_PAIR_KEYS}),
found AS (SELECT * FROM singles WHERE is_key UNION ALL SELECT * FROM pairs WHERE is_key AND t NOT IN (SELECT t FROM singles WHERE is_key))
SELECT t AS table_name, k AS key_columns, CAST(i AS INTEGER) AS ordinal, string_split(k, ',')[i] AS column_name
FROM (SELECT t, k, UNNEST(range(1, w + 1)) AS i FROM found) x
"""

_AVERAGES = """
SELECT r.r_name, CAST(date_trunc('year', o.o_orderdate) AS DATE) AS period,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(o.o_totalprice) AS avg_price,
       CAST(SUM(CAST(o.o_custkey AS DECIMAL(38,0))) AS DOUBLE) / COUNT(o.o_custkey) AS avg_customer
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, CAST(date_trunc('year', o.o_orderdate) AS DATE)
"""
ORACLE_SQL["fact_avg_star"] = _AVERAGES
ORACLE_SQL["fact_avg_star_large_dims"] = _AVERAGES
ORACLE_SQL["rollup_published_avg"] = _AVERAGES

ORACLE_SQL["fact_incremental_avg"] = """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type, CAST(SUM(CAST(user_id AS DECIMAL(38,0))) AS DOUBLE) / COUNT(user_id) AS avg_user, COUNT(*) AS event_count
FROM events GROUP BY CAST(date_trunc('day', ts) AS DATE), event_type
"""


ORACLE_SQL["dim_customer"] = """
SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer
"""

ORACLE_SQL["dim_part"] = """
SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
"""

ORACLE_SQL["dim_supplier"] = """
SELECT s_suppkey, s_name, s_nationkey FROM supplier
"""

ORACLE_SQL["dim_user_dedup"] = """
SELECT DISTINCT user_id FROM events
"""

ORACLE_SQL["dim_date"] = """
SELECT CAST(d AS DATE) AS date_key, CAST(EXTRACT(year FROM d) AS INTEGER) AS year, CAST(EXTRACT(quarter FROM d) AS INTEGER) AS quarter, CAST(EXTRACT(month FROM d) AS INTEGER) AS month
FROM (SELECT UNNEST(generate_series(MIN(o_orderdate), MAX(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) t
"""

ORACLE_SQL["fact_orders"] = """
SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o_orderkey) AS order_count FROM orders GROUP BY o_custkey
"""

ORACLE_SQL["fact_distinct_customers"] = """
SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS distinct_customers FROM orders GROUP BY o_orderpriority
"""

ORACLE_SQL["fact_avg"] = """
SELECT o_orderstatus, ROUND(AVG(o_totalprice), 4) AS avg_order_value FROM orders GROUP BY o_orderstatus
"""

ORACLE_SQL["fact_min_max"] = """
SELECT o_custkey, MIN(o_orderdate) AS first_order, MAX(o_totalprice) AS largest_order, MAX(o_orderpriority) AS max_priority FROM orders GROUP BY o_custkey
"""

ORACLE_SQL["fact_lineitem_expr"] = """
SELECT l_suppkey, l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS net_revenue, COUNT(*) AS line_count FROM lineitem GROUP BY l_suppkey, l_returnflag
"""

ORACLE_SQL["fact_status_degenerate"] = """
SELECT o_custkey, o_orderstatus, COUNT(*) AS order_count FROM orders GROUP BY o_custkey, o_orderstatus
"""

ORACLE_SQL["fact_grand_total"] = """
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(*) AS order_count FROM orders
"""

ORACLE_SQL["fact_factless"] = """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
"""

ORACLE_SQL["fact_multi_source"] = """
SELECT o.o_custkey, l.l_suppkey, CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_suppkey
"""

ORACLE_SQL["filter_equality"] = """
SELECT o_custkey, COUNT(*) AS order_count FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey
"""

ORACLE_SQL["filter_year_from"] = """
SELECT o_orderstatus, COUNT(*) AS order_count FROM orders WHERE EXTRACT(year FROM o_orderdate) >= 1998 GROUP BY o_orderstatus
"""

ORACLE_SQL["grain_daily"] = """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type, COUNT(*) AS event_count FROM events GROUP BY CAST(date_trunc('day', ts) AS DATE), event_type
"""

ORACLE_SQL["grain_weekly"] = """
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, COUNT(*) AS order_count FROM orders GROUP BY CAST(date_trunc('week', o_orderdate) AS DATE)
"""

ORACLE_SQL["grain_monthly"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), o_custkey
"""

ORACLE_SQL["grain_quarterly"] = """
SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, COUNT(*) AS order_count FROM orders GROUP BY CAST(date_trunc('quarter', o_orderdate) AS DATE)
"""

ORACLE_SQL["grain_yearly"] = """
SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS period, l_returnflag, COUNT(*) AS line_count FROM lineitem GROUP BY CAST(date_trunc('year', l_shipdate) AS DATE), l_returnflag
"""

ORACLE_SQL["star_rollup"] = """
SELECT r.r_name, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o.o_orderkey) AS order_count
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_orderstatus = 'F' GROUP BY r.r_name, CAST(date_trunc('month', o.o_orderdate) AS DATE)
"""

ORACLE_SQL["rollup_from_fact"] = """
SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(*) AS order_count, MIN(o_totalprice) AS smallest, MAX(o_totalprice) AS largest FROM orders GROUP BY CAST(date_trunc('year', o_orderdate) AS DATE)
"""

ORACLE_SQL["check_not_null"] = """
SELECT 'o_custkey' AS column_name, COUNT(*) - COUNT(o_custkey) AS n_violations FROM orders UNION ALL SELECT 'o_totalprice', COUNT(*) - COUNT(o_totalprice) FROM orders
"""

ORACLE_SQL["check_unique"] = """
SELECT 'c_custkey' AS column_name, COUNT(*) AS n_violations FROM (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_custkey HAVING COUNT(*) > 1) a
UNION ALL SELECT 'l_orderkey', COUNT(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING COUNT(*) > 1) b
"""

ORACLE_SQL["check_relationships"] = """
SELECT 'o_custkey' AS column_name, COUNT(*) AS n_violations FROM orders o WHERE o.o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'l_partkey', COUNT(*) FROM lineitem l WHERE l.l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
"""

ORACLE_SQL["check_relationships_orphans"] = """
SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""

ORACLE_SQL["check_accepted_values"] = """
SELECT 'o_orderpriority' AS column_name, COUNT(*) AS n_violations FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
"""

ORACLE_SQL["accepted_domains"] = """
SELECT DISTINCT 'c_mktsegment' AS column_name, c_mktsegment AS accepted_value FROM customer WHERE c_mktsegment IS NOT NULL
"""

ORACLE_SQL["check_report"] = """
SELECT 'dim_customer' AS table_name, 'c_custkey' AS column_name, 'not_null' AS check_name, COUNT(*) - COUNT(c_custkey) AS n_violations, COUNT(*) = COUNT(c_custkey) AS passed FROM customer
UNION ALL SELECT 'dim_customer', 'c_custkey', 'unique', COUNT(*), COUNT(*) = 0 FROM (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_custkey HAVING COUNT(*) > 1) a
UNION ALL SELECT 'dim_customer', 'c_mktsegment', 'accepted_values', 0, TRUE
UNION ALL SELECT 'fact_orders', 'o_custkey', 'not_null', COUNT(*), COUNT(*) = 0 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NULL) b
UNION ALL SELECT 'fact_orders', 'o_custkey', 'relationships', COUNT(*), COUNT(*) = 0 FROM (SELECT DISTINCT o.o_custkey FROM orders o WHERE o.o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) d
UNION ALL SELECT 'fact_orders', 'total_revenue', 'not_null', COUNT(*), COUNT(*) = 0 FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) IS NULL) e
UNION ALL SELECT 'fact_orders', 'order_count', 'not_null', 0, TRUE
"""

ORACLE_SQL["check_report_violations"] = ORACLE_SQL["check_report"].replace(
    "UNION ALL SELECT 'dim_customer', 'c_mktsegment', 'accepted_values', 0, TRUE",
    "UNION ALL SELECT 'dim_customer', 'c_mktsegment', 'accepted_values', COUNT(*), COUNT(*) = 0 FROM customer "
    "WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")

ORACLE_SQL["mart_roundtrip"] = """
SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o_orderkey) AS order_count FROM orders GROUP BY o_custkey
"""

ORACLE_SQL["fact_incremental"] = """
SELECT user_id, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value, COUNT(*) AS event_count, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events GROUP BY user_id, event_type
"""
ORACLE_SQL["intent_segment_quarterly"] = """
SELECT c.c_mktsegment, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o.o_orderkey) AS order_count
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE EXTRACT(year FROM o.o_orderdate) >= 1997 GROUP BY c.c_mktsegment, CAST(date_trunc('quarter', o.o_orderdate) AS DATE)
"""

ORACLE_SQL["mart_publish"] = """
SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o_orderkey) AS order_count FROM orders GROUP BY o_custkey
"""

ORACLE_SQL["mart_catalog_rollup"] = """
SELECT r.r_name, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o.o_orderkey) AS order_count
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, CAST(date_trunc('quarter', o.o_orderdate) AS DATE)
"""

ORACLE_SQL["mart_republished"] = """
SELECT run, r.r_name, CAST(date_trunc('year', o.o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o.o_orderkey) AS order_count
FROM (VALUES ('early', DATE '1996-01-01'), ('current', NULL)) AS v(run, ends) JOIN orders o ON v.ends IS NULL OR o.o_orderdate < v.ends
LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY run, r.r_name, CAST(date_trunc('year', o.o_orderdate) AS DATE)
"""

ORACLE_SQL["intent_region_filter"] = """
SELECT c.c_mktsegment, CAST(date_trunc('year', o.o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o.o_orderkey) AS order_count
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA' GROUP BY c.c_mktsegment, CAST(date_trunc('year', o.o_orderdate) AS DATE)
"""

# The same results, planned for sides beyond the broadcast bound.
ORACLE_SQL["star_rollup_large_dims"] = ORACLE_SQL["star_rollup"]
ORACLE_SQL["fact_multi_source_large_side"] = ORACLE_SQL["fact_multi_source"]
ORACLE_SQL["check_relationships_large_parent"] = ORACLE_SQL["check_relationships"]
ORACLE_SQL["check_relationships_orphans_large_parent"] = ORACLE_SQL["check_relationships_orphans"]

ORACLE_SQL["source_catalog"] = f"""
SELECT c.table_name, CAST(c.ordinal_position AS INTEGER) AS ordinal, c.column_name,
       CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
            WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(c.data_type) END AS data_type,
       c.is_nullable = 'YES' AS is_nullable, COALESCE(k.is_key, FALSE) AS is_primary_key, r.row_count
FROM information_schema.columns c
LEFT JOIN ({_ROW_COUNTS}) r ON r.table_name = c.table_name
LEFT JOIN ({_SINGLE_KEYS}) k ON k.t = c.table_name AND k.k = c.column_name
WHERE c.table_schema = 'main' AND c.table_name IN ({', '.join(f"'{t}'" for t in _COLUMNS)})
"""

ORACLE_SQL["fact_incremental_partitioned"] = """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value, COUNT(*) AS event_count, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events GROUP BY CAST(date_trunc('day', ts) AS DATE), event_type
"""

ORACLE_SQL["fact_incremental_null_period"] = """
SELECT CAST(date_trunc('day', t) AS DATE) AS period, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value, COUNT(*) AS event_count, MIN(t) AS first_ts, MAX(t) AS last_ts
FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events) e GROUP BY CAST(date_trunc('day', t) AS DATE), event_type
"""

ORACLE_SQL["catalog_stats_row_counts"] = ORACLE_SQL["catalog_row_counts"]

ORACLE_SQL["catalog_tables"] = """
SELECT DISTINCT table_name FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ('benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier') ORDER BY table_name
"""

ORACLE_SQL["intent_published"] = """
SELECT r.r_name, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o.o_orderkey) AS order_count
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_mktsegment = 'AUTOMOBILE' AND EXTRACT(year FROM o.o_orderdate) >= 1996
GROUP BY r.r_name, CAST(date_trunc('quarter', o.o_orderdate) AS DATE)
"""

ORACLE_SQL["check_unique_rows"] = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l
JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) d
ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber
"""

_TWO_GRAINS_LINES = """SELECT o.o_custkey, CAST(date_trunc('year', o.o_orderdate) AS DATE) AS period,
         CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, COUNT(*) AS line_count
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2"""
ORACLE_SQL["fact_two_grains"] = ORACLE_SQL["fact_two_grains_large_side"] = f"""
WITH a AS ({_TWO_GRAINS_LINES}),
b AS (SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
             COUNT(o_orderkey) AS order_count, CAST(SUM(CAST(o_custkey AS DECIMAL(38,0))) AS DOUBLE) / COUNT(o_custkey) AS avg_customer, MIN(o_totalprice) AS cheapest_order
      FROM orders GROUP BY 1, 2)
SELECT COALESCE(a.period, b.period) AS period, COALESCE(a.o_custkey, b.o_custkey) AS o_custkey, a.quantity, COALESCE(a.line_count, 0) AS line_count,
       b.total_revenue, COALESCE(b.order_count, 0) AS order_count, b.avg_customer, b.cheapest_order
FROM a FULL OUTER JOIN b ON a.period IS NOT DISTINCT FROM b.period AND a.o_custkey IS NOT DISTINCT FROM b.o_custkey
"""

ORACLE_SQL["fact_order_lines"] = """
WITH a AS (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, COUNT(*) AS line_count FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o_orderkey) AS order_count FROM orders GROUP BY 1)
SELECT COALESCE(l_orderkey, o_orderkey) AS l_orderkey, quantity, COALESCE(line_count, 0) AS line_count, total_revenue, COALESCE(order_count, 0) AS order_count
FROM a FULL OUTER JOIN b ON l_orderkey = o_orderkey
"""

ORACLE_SQL["star_two_grains"] = """
WITH geo AS (SELECT c_custkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT * FROM orders LEFT JOIN geo ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
a AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, r_name, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, COUNT(*) AS line_count
      FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, r_name, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o_orderkey) AS order_count
      FROM o GROUP BY 1, 2)
SELECT COALESCE(a.period, b.period) AS period, COALESCE(a.r_name, b.r_name) AS r_name, quantity, COALESCE(line_count, 0) AS line_count, total_revenue, COALESCE(order_count, 0) AS order_count
FROM a FULL OUTER JOIN b ON a.period IS NOT DISTINCT FROM b.period AND a.r_name IS NOT DISTINCT FROM b.r_name
"""

ORACLE_SQL["intent_across_facts"] = """
WITH c AS (SELECT c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
o AS (SELECT * FROM orders JOIN c ON o_custkey = c_custkey),
a AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, c_mktsegment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, COUNT(o_orderkey) AS order_count
      FROM o GROUP BY 1, 2),
b AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, c_mktsegment, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
      FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT COALESCE(a.period, b.period) AS period, COALESCE(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, total_revenue, quantity, COALESCE(order_count, 0) AS order_count
FROM a FULL OUTER JOIN b ON a.period IS NOT DISTINCT FROM b.period AND a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment
"""

_GEO = "SELECT c_custkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
ORACLE_SQL["rollup_published_distinct"] = f"""
WITH geo AS ({_GEO}),
a AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, r_name, COUNT(DISTINCT l_partkey) AS distinct_parts, COUNT(*) AS line_count
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN geo ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, r_name, COUNT(DISTINCT o_orderpriority) AS distinct_priorities, COUNT(DISTINCT o_orderkey) AS distinct_orders
      FROM orders LEFT JOIN geo ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT COALESCE(a.period, b.period) AS period, COALESCE(a.r_name, b.r_name) AS r_name, COALESCE(distinct_parts, 0) AS distinct_parts, COALESCE(line_count, 0) AS line_count,
       COALESCE(distinct_priorities, 0) AS distinct_priorities, COALESCE(distinct_orders, 0) AS distinct_orders
FROM a FULL OUTER JOIN b ON a.period IS NOT DISTINCT FROM b.period AND a.r_name IS NOT DISTINCT FROM b.r_name
"""

ORACLE_SQL["fact_incremental_distinct"] = """
SELECT event_type, COUNT(DISTINCT user_id) AS distinct_users, COUNT(DISTINCT props) AS distinct_props, COUNT(*) AS event_count FROM events GROUP BY event_type
"""

_TRIPLE_KEYS = _union_all(_key_test(t, [cs[i][0], cs[j][0], cs[k][0]]) for t, cs in _COLUMNS.items()
                          for i in range(len(cs)) for j in range(i + 1, len(cs)) for k in range(j + 1, len(cs)))
ORACLE_SQL["minimal_keys"] = f"""
WITH tests AS ({_SINGLE_KEYS} UNION ALL {_PAIR_KEYS} UNION ALL {_TRIPLE_KEYS}), keys AS (SELECT t, k, w, string_split(k, ',') AS cs FROM tests WHERE is_key),
found AS (SELECT * FROM keys a WHERE NOT EXISTS (SELECT 1 FROM keys b WHERE a.t = b.t AND b.w < a.w AND list_has_all(a.cs, b.cs)))
SELECT t AS table_name, k AS key_columns, CAST(i AS INTEGER) AS ordinal, cs[i] AS column_name FROM (SELECT t, k, cs, UNNEST(range(1, w + 1)) AS i FROM found) x
"""

ORACLE_SQL["inclusions"] = f"""
WITH vals AS ({_union_all(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{f}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in _COLUMNS.items() for c, f in cs)}),
tests AS ({_SINGLE_KEYS}), sizes AS (SELECT t, c, f, COUNT(*) AS d FROM vals GROUP BY t, c, f),
cols AS (SELECT s.*, k.is_key FROM sizes s JOIN tests k ON s.t = k.t AND s.c = k.k),
met AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, COUNT(*) AS m FROM vals a JOIN vals b ON a.f = b.f AND a.v = b.v
        WHERE (b.t, b.c) IN (SELECT t, c FROM cols WHERE is_key) AND NOT (a.t = b.t AND a.c = b.c) GROUP BY a.t, a.c, b.t, b.c)
SELECT c.t AS child_table, c.c AS child_columns, p.t AS parent_table, p.c AS parent_columns, c.d AS child_distinct, p.d AS parent_distinct,
       CAST(c.d AS DOUBLE) / p.d AS parent_coverage, c.is_key AS one_to_one
FROM met JOIN cols c ON c.t = ct AND c.c = cc AND c.d = m JOIN cols p ON p.t = pt AND p.c = pc
"""

# Tables that the search for two-column links is shown, one of them derived.
_SHOWN = {
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_returnflag:str", "partsupp": "ps_partkey:int ps_suppkey:int",
    "part": "p_partkey:int p_name:str p_brand:str p_type:str p_size:int", "conversations": "conv_id:int turn:int",
}
_SHOWN = {t: [tuple(c.split(":")) for c in cs.split()] for t, cs in _SHOWN.items()}


def _pair_link(child: str, c: tuple, parent: str, p: tuple) -> str:
    """The row of a link between two columns each, if it is one."""
    ct, pt = (t if t != "partsupp" else "offers" for t in (child, parent))
    (a, b), (x, y) = c, p
    minimal = " AND ".join(f"NOT (SELECT is_key FROM ({_key_test(pt, [k])}) s)" for k in p)
    children = f"SELECT DISTINCT {a} AS a, {b} AS b FROM {ct} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"SELECT '{child}' AS child_table, '{a},{b}' AS child_columns, '{parent}' AS parent_table, '{x},{y}' AS parent_columns, "
            f"(SELECT COUNT(*) FROM ({children}) d) AS child_distinct, (SELECT COUNT(*) FROM (SELECT DISTINCT {x}, {y} FROM {pt}) d) AS parent_distinct, "
            f"(SELECT is_key FROM ({_key_test(ct, [a, b])}) s) AS one_to_one "
            f"WHERE (SELECT is_key FROM ({_key_test(pt, [x, y])}) s) AND {minimal} AND NOT EXISTS (({children}) EXCEPT (SELECT {x}, {y} FROM {pt}))")


_PAIR_LINKS = _union_all(
    _pair_link(ct, (a[0], b[0]), pt, (x[0], y[0]))
    for pt, ps in _SHOWN.items() for i, x in enumerate(ps) for y in ps[i + 1:]
    for ct, cs in _SHOWN.items() for a in cs for b in cs
    if a != b and (a[1], b[1]) == (x[1], y[1]) and (ct, a, b) != (pt, x, y))
ORACLE_SQL["composite_foreign_keys"] = f"""
WITH offers AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem), links AS ({_PAIR_LINKS})
SELECT *, CAST(child_distinct AS DOUBLE) / parent_distinct AS parent_coverage FROM links WHERE child_distinct > 0
"""

_WIDE = """SELECT o_orderkey, o_custkey, c_name, c_mktsegment, c_nationkey, n_name, n_regionkey, r_name, o_orderstatus, o_orderpriority
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
_WIDE_COLUMNS = _WIDE.split("FROM")[0].replace("SELECT", "").replace(" ", "").strip().split(",")


def _determines(x: str, a: str) -> str:
    count = lambda cs: f"(SELECT COUNT(*) FROM (SELECT DISTINCT {cs} FROM wide) d)"
    return (f"SELECT '{x}' AS determinant, '{a}' AS dependent WHERE {count(x)} = {count(f'{x}, {a}')} AND {count(x)} < (SELECT COUNT(*) FROM wide) "
            f"AND {count(a)} > 1 AND {count(x)} > 1")


ORACLE_SQL["functional_dependencies"] = f"WITH wide AS ({_WIDE}) " + _union_all(_determines(x, a) for x in _WIDE_COLUMNS for a in _WIDE_COLUMNS if a != x)
ORACLE_SQL["dim_hidden_customer"] = f"SELECT DISTINCT o_custkey, c_name, c_mktsegment, c_nationkey, n_name, n_regionkey, r_name FROM ({_WIDE}) w"

ORACLE_SQL["fact_corrected"] = """
WITH e AS (SELECT *, event_id % 3 = 0 OR EXTRACT(day FROM ts) = 7 AS gone FROM events),
rest AS (SELECT event_id, ts, user_id, event_type, value FROM e WHERE NOT gone UNION ALL SELECT event_id, ts, user_id, 'corrected', value FROM e WHERE gone AND event_id % 2 = 0)
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value, COUNT(*) AS event_count,
       MIN(ts) AS first_ts, MAX(ts) AS last_ts, CAST(SUM(CAST(user_id AS DECIMAL(38,0))) AS DOUBLE) / COUNT(user_id) AS avg_user, COUNT(DISTINCT user_id) AS distinct_users
FROM rest GROUP BY 1, 2
"""

ORACLE_SQL["check_refresh"] = """
WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 50 = 0 THEN o_orderkey + 100000000 WHEN o_orderkey % 3 = 0 AND o_orderkey % 77 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
                  CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice, o_orderkey FROM orders),
f AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total_revenue, COUNT(o_orderkey) AS order_count FROM o GROUP BY o_custkey),
r AS (SELECT 'o_custkey' AS column_name, 'not_null' AS check_name, (SELECT COUNT(*) FROM f WHERE o_custkey IS NULL) AS n_violations
      UNION ALL SELECT 'total_revenue', 'not_null', (SELECT COUNT(*) FROM f WHERE total_revenue IS NULL)
      UNION ALL SELECT 'order_count', 'not_null', (SELECT COUNT(*) FROM f WHERE order_count IS NULL)
      UNION ALL SELECT 'o_custkey', 'relationships', (SELECT COUNT(*) FROM f WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)))
SELECT 'fact_orders' AS table_name, column_name, check_name, n_violations, n_violations = 0 AS passed FROM r
"""

ORACLE_SQL["proposed_fact"] = f"""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(SUM(l_linenumber) AS DOUBLE) AS sum_l_linenumber,
       {", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS sum_{c}" for c in _MEASURES["lineitem"])}, COUNT(*) AS row_count
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey
"""

_REVENUE_BY = "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value"
ORACLE_SQL["intent_navigated"] = f"""
WITH o AS (SELECT *, CAST(date_trunc('year', o_orderdate) AS DATE) AS y FROM orders LEFT JOIN ({_GEO}) g ON o_custkey = c_custkey)
SELECT 'by_priority_yearly' AS fact, y AS period, o_orderpriority AS label, {_REVENUE_BY} FROM o GROUP BY 2, 3
UNION ALL SELECT 'by_customer_yearly', y, r_name, {_REVENUE_BY} FROM o WHERE y >= DATE '1995-01-01' GROUP BY 2, 3
UNION ALL SELECT 'finished_yearly', y, r_name, {_REVENUE_BY} FROM o WHERE o_orderstatus = 'F' GROUP BY 2, 3
UNION ALL SELECT 'by_customer_daily', CAST(date_trunc('quarter', o_orderdate) AS DATE), r_name, CAST(COUNT(DISTINCT o_orderpriority) AS DOUBLE) FROM o GROUP BY 2, 3
"""
