"""Key and relationship discovery: inclusion dependencies and star proposals.

``foreign_keys`` measures, for each candidate (child column -> parent column),
how many distinct child values exist, how many of them the parent holds, and
what share of the parent's values is referenced.  Star proposals need inclusions only,
which samples refute before anything is measured (``dependencies``).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.operators.dependencies import Columns, Found, included, meetings, minimal_keys
from starmart.operators.profile import candidate_keys, key_like_columns, key_tests, shortlist_keys_many, shortlist_keys_of_width, value_family

KEY_SCHEMA = "table_name string, key_columns string, is_key boolean"
FK_SCHEMA = ("child_table string, child_column string, parent_table string, parent_column string")


def _col_type(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def foreign_keys(tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Coverage of each ``(child_table, child_column, parent_table, parent_column)``.

    Columns: child_table, child_column, parent_table, parent_column,
    child_distinct, matched_distinct, parent_distinct, parent_coverage
    (matched / parent distinct), child_coverage (matched / child distinct; both
    null without values).  Candidates whose types are incompatible get no row.
    One job measures all candidates; what reaches the driver is a count per
    column and per candidate.
    """
    spark = next(iter(tables.values())).sparkSession
    pairs = [(Columns(ct, (cc,)), Columns(pt, (pc,))) for ct, cc, pt, pc in dict.fromkeys(map(tuple, candidates))
             if value_family(_col_type(tables[ct], cc)) == value_family(_col_type(tables[pt], pc))]
    n = meetings(tables, pairs)
    out = []
    for c, p in pairs:
        children, parents, matched = n.get((c, c), 0), n.get((p, p), 0), n.get((c, p), 0)
        out.append((c.table, c.names[0], p.table, p.names[0], children, matched, parents,
                    matched / parents if parents else None, matched / children if children else None))
    return spark.createDataFrame(out, FK_SCHEMA + ", child_distinct bigint, matched_distinct bigint, "
                                      "parent_distinct bigint, parent_coverage double, child_coverage double")


def discover_keys(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None,
                  pairs: bool = True) -> DataFrame:
    """Exact candidate keys of each table (HyperLogLog shortlist, exact confirm).

    Wider column sets are tried only for tables without a smaller key."""
    names = list(names if names is not None else tables)
    short = shortlist_keys_many(tables, names, pairs=pairs)
    candidates = [(t, list(s)) for t in names for s in short[t]]
    return candidate_keys(tables, candidates)


def key_columns(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None, max_width: int = 2) -> DataFrame:
    """``(table_name, key_columns, ordinal, column_name)``: the smallest keys of each
    table, one row per key column.

    Single columns are confirmed first; a table none of whose columns is a key has
    its sets of 2, then 3, ... up to ``max_width`` columns searched, so composite keys
    are found and no key that contains a smaller one is listed.
    """
    names = list(names if names is not None else tables)
    found, open_ = [], names
    for width in range(1, max_width + 1):
        sets = shortlist_keys_of_width(tables, open_, width)
        candidates = [Columns(t, s) for t in open_ for s in sets[t]]
        keys = [c for c, is_key in zip(candidates, key_tests(tables, candidates)) if is_key]
        found += keys
        open_ = [t for t in open_ if t not in {c.table for c in keys}]
    return _key_rows(next(iter(tables.values())).sparkSession, found)


def minimal_key_columns(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None, max_width: int = 3) -> DataFrame:
    """As :func:`key_columns`, but every minimal key up to ``max_width`` columns, beside smaller ones too."""
    return _key_rows(next(iter(tables.values())).sparkSession, minimal_keys(tables, names, max_width))


def _key_rows(spark, keys: Sequence[Columns]) -> DataFrame:
    rows = [(c.table, ",".join(c.names), list(c.names)) for c in keys]
    out = spark.createDataFrame(rows, "table_name string, key_columns string, names array<string>")
    return out.select("table_name", "key_columns", F.posexplode("names").alias("p", "column_name")).select(
        "table_name", "key_columns", (F.col("p") + 1).alias("ordinal"), "column_name")


LINK_SCHEMA = ("child_table string, child_columns string, parent_table string, parent_columns string, child_distinct bigint, "
               "parent_distinct bigint, parent_coverage double, one_to_one boolean")


def link_rows(spark, found: Found) -> DataFrame:
    """Inclusions as rows; the columns of a set are comma-joined."""
    return spark.createDataFrame([(i.child.table, ",".join(i.child.names), i.parent.table, ",".join(i.parent.names), i.child_distinct,
                                   i.parent_distinct, i.parent_coverage, i.one_to_one) for i in found.inclusions], LINK_SCHEMA)


def fk_candidates(tables: Mapping[str, DataFrame], keys: Sequence[tuple[str, str]],
                  names: Sequence[str] | None = None) -> list[tuple[str, str, str, str]]:
    """Every type-compatible (child column -> single-column parent key) pair.

    A column that is itself a single-column key of its table is not a child
    (that would be a 1:1 link, not a fact -> dimension reference)."""
    names = list(names if names is not None else tables)
    own = set(keys)
    out = []
    for pt, pc in keys:
        pfam = value_family(_col_type(tables[pt], pc))
        for ct in names:
            for cc in key_like_columns(tables[ct]):
                if (ct, cc) in own:
                    continue
                if value_family(_col_type(tables[ct], cc)) == pfam:
                    out.append((ct, cc, pt, pc))
    return out


def discover_foreign_keys(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """:func:`foreign_keys` of every type-compatible column with every confirmed single-column key."""
    names = list(names if names is not None else tables)
    return foreign_keys(tables, fk_candidates(tables, _single_keys(tables, names), names))


def _single_keys(tables: Mapping[str, DataFrame], names: Sequence[str]) -> list[tuple[str, str]]:
    return [(c.table, c.names[0]) for c in minimal_keys(tables, names, max_width=1)]


def _suffix(c):
    return F.regexp_extract(c, r"^[^_]*_(.+)$", 1)


def rank_foreign_keys(fks: DataFrame) -> DataFrame:
    """Inclusion dependencies (every child value found in the parent), ranked
    per child column: shared name suffix first (``o_custkey`` ~ ``c_custkey``),
    then higher parent coverage, then smaller parent."""
    inc = fks.where((F.col("child_distinct") > 0) & (F.col("matched_distinct") == F.col("child_distinct")))
    name_match = ((F.col("child_column") == F.col("parent_column"))
                  | ((_suffix(F.col("child_column")) != "")
                     & (_suffix(F.col("child_column")) == _suffix(F.col("parent_column"))))).alias("name_match")
    scored = inc.select("*", name_match)
    from pyspark.sql import Window
    w = Window.partitionBy("child_table", "child_column").orderBy(
        F.col("name_match").desc(), F.col("parent_coverage").desc(), F.col("parent_distinct").asc(),
        F.col("parent_table"), F.col("parent_column"))
    return scored.withColumn("rank", F.row_number().over(w))


def accepted_link(min_coverage: float = 0.9):
    """A child column's best inclusion, if its name or its coverage of the parent
    speaks for a reference (dense integers include each other by accident)."""
    return (F.col("rank") == 1) & (F.col("name_match") | (F.col("parent_coverage") >= min_coverage))


def star_candidates(tables: Mapping[str, DataFrame], keys: DataFrame | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Ranked star proposals.

    A table with an outgoing inclusion dependency and at least one numeric
    non-key column is a fact candidate; each referenced parent is a dimension
    candidate.  Columns: fact_table, fact_key, dimension_table, dimension_key,
    parent_coverage, name_match, rank (1 = best dimension for that key),
    n_measures (numeric columns, integers included, that are neither a key nor an
    accepted link: they become SUM metrics).
    """
    names = list(names if names is not None else tables)
    if keys is None:
        # Parents of a star are single-column keys: no pair search needed here.
        single = _single_keys(tables, names)
    else:
        single = [(r["table_name"], r["key_columns"]) for r in keys.where("is_key").collect() if r["key_columns"] in tables[r["table_name"]].columns]
    cands = fk_candidates(tables, single, names)
    if not cands:
        spark = tables[names[0]].sparkSession
        return spark.createDataFrame([], "fact_table string, fact_key string, dimension_table string, "
                                         "dimension_key string, parent_coverage double, name_match boolean, "
                                         "rank int, n_measures int")
    # only inclusions are ranked, so what samples refute need not be measured
    found = included(tables, [(Columns(ct, (cc,)), Columns(pt, (pc,))) for ct, cc, pt, pc in cands])
    ranked = rank_foreign_keys(tables[names[0]].sparkSession.createDataFrame(
        [(*i.child[:1], *i.child.names, *i.parent[:1], *i.parent.names, i.child_distinct, i.child_distinct, i.parent_distinct, i.parent_coverage)
         for i in found.inclusions], FK_SCHEMA + ", child_distinct bigint, matched_distinct bigint, parent_distinct bigint, parent_coverage double"))
    own_keys = {(t, k) for t, k in single}
    spark = tables[names[0]].sparkSession
    numeric = [(t, f.name) for t in names for f in tables[t].schema.fields
               if isinstance(f.dataType, T.NumericType) and (t, f.name) not in own_keys]
    columns = spark.createDataFrame(numeric, "child_table string, child_column string")
    links = ranked.where(accepted_link() & (F.col("child_table") != F.col("parent_table"))).select("child_table", "child_column")
    # metadata frames: a row per column
    m = columns.join(links, ["child_table", "child_column"], "left_anti").groupBy("child_table").agg(
        F.count(F.lit(1)).cast("int").alias("n_measures"))
    return (ranked.join(F.broadcast(m), "child_table")
            .where(F.col("child_table") != F.col("parent_table"))
            .select(F.col("child_table").alias("fact_table"), F.col("child_column").alias("fact_key"),
                    F.col("parent_table").alias("dimension_table"), F.col("parent_column").alias("dimension_key"),
                    "parent_coverage", "name_match", F.col("rank").cast("int").alias("rank"), "n_measures"))


def propose_marts(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None,
                  min_coverage: float = 0.9, candidates: DataFrame | None = None) -> list:
    """Buildable star proposals, best first.

    Each fact-candidate table becomes a ``MartSpec``: its foreign keys are the
    rank-1 links that either share a name suffix with the parent key or cover at
    least ``min_coverage`` of the parent's values (dense integer keys include
    each other by accident; such weak links are dropped); every numeric non-key
    column becomes a SUM metric, plus a row count; each referenced parent
    becomes a dimension with its other columns as attributes.  Only the ranked
    report (one row per candidate link) reaches the driver.
    """
    from starmart.spec import Dimension, Fact, MartSpec, Metric

    names = list(names if names is not None else tables)
    confirmed = _single_keys(tables, names)
    if candidates is None:
        keys = tables[names[0]].sparkSession.createDataFrame([(t, k, True) for t, k in confirmed], KEY_SCHEMA)
        candidates = star_candidates(tables, keys, names)
    cands = candidates
    links = [r.asDict() for r in cands.where(accepted_link(min_coverage)).collect()]
    by_fact: dict[str, list[dict]] = {}
    for r in links:
        by_fact.setdefault(r["fact_table"], []).append(r)
    own_keys = set(confirmed)  # a table's own key is no measure
    specs = []
    for fact_table, fks in by_fact.items():
        fks.sort(key=lambda r: r["fact_key"])
        schema = tables[fact_table].schema
        fk_cols = {r["fact_key"] for r in fks}
        measures = [f.name for f in schema.fields
                    if isinstance(f.dataType, T.NumericType) and f.name not in fk_cols and (fact_table, f.name) not in own_keys]
        metrics = [Metric(f"sum_{c}", "sum", c) for c in measures] + [Metric("row_count", "count")]
        dims, key_map = [], {}
        for r in fks:
            parent, pkey = r["dimension_table"], r["dimension_key"]
            dname = f"dim_{parent}"
            if dname not in [d.name for d in dims]:
                attrs = tuple(c for c in tables[parent].columns if c != pkey)
                dims.append(Dimension(dname, parent, pkey, attrs))
            key_map[r["fact_key"]] = dname
        fact = Fact(f"fact_{fact_table}", (fact_table,), tuple(metrics), tuple(r["fact_key"] for r in fks),
                    key_map=key_map)
        specs.append(MartSpec(f"{fact_table}_mart", (fact,), tuple(dims),
                              description=f"proposed from discovered keys of {fact_table}"))
    specs.sort(key=lambda s: (-len(s.dimensions), -len(s.facts[0].metrics), s.mart_name))
    return specs
