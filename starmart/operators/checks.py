"""Data checks executed as Spark jobs.

Every check yields rows ``(table_name, column_name, check_name, n_violations,
passed)``:

* ``not_null``        rows with a NULL in the column;
* ``unique``          non-null key values that occur more than once;
* ``relationships``   child rows whose non-null key has no parent row;
* ``accepted_values`` non-null values outside the accepted list.

All not_null and accepted_values checks of one table share a single aggregate
pass.  ``relationships`` aggregates the child keys first (map-side combine: a
key held by a third of the rows becomes one row) and anti-joins the distinct
keys, so skew never reaches the join.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.functions.grain import PERIOD
from starmart.operators.dims import build_dimension
from starmart.operators.facts import build_fact, fact_keys
from starmart.plans.joins import broadcast_bound, fits_broadcast, skew_split_join
from starmart.spec import Fact, MartSpec

REPORT_SCHEMA = "table_name string, column_name string, check_name string, n_violations bigint, passed boolean"

# Fixed value: at most this many distinct values make an accepted-values rule.
MAX_ACCEPTED_VALUES = 10


def _report(df: DataFrame, table: str, column: str, check: str) -> DataFrame:
    """``df`` holds one row with column ``n``."""
    return df.select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(check).alias("check_name"),
        F.col("n").cast("bigint").alias("n_violations"), (F.col("n") == 0).alias("passed"),
    )


def _union(parts: Sequence[DataFrame], spark=None) -> DataFrame:
    if not parts:
        from pyspark.sql import SparkSession
        return (spark or SparkSession.getActiveSession()).createDataFrame([], REPORT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_checks(df: DataFrame, table: str, not_null: Sequence[str] = (),
                  accepted: Mapping[str, Sequence] | None = None) -> DataFrame | None:
    """not_null and accepted_values checks of one table in one aggregate pass."""
    accepted = dict(accepted or {})
    specs = [(c, "not_null", F.count_if(F.col(c).isNull())) for c in not_null]
    for c, values in accepted.items():
        t = df.schema[c].dataType
        lits = [F.lit(v).cast(t) for v in values]
        bad = F.col(c).isNotNull() & ~F.col(c).isin(*lits) if lits else F.col(c).isNotNull()
        specs.append((c, "accepted_values", F.count_if(bad)))
    if not specs:
        return None
    wide = df.agg(*[a.alias(f"__c{i}") for i, (_, _, a) in enumerate(specs)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"), F.col(f"__c{i}").alias("n"))
        for i, (c, k, _) in enumerate(specs)
    ])).alias("r")
    return wide.select(rows).select(
        F.lit(table).alias("table_name"), "r.column_name", "r.check_name",
        F.col("r.n").cast("bigint").alias("n_violations"), (F.col("r.n") == 0).alias("passed"))


def not_null_counts(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    return column_checks(df, table, not_null=columns)


def accepted_values_counts(df: DataFrame, accepted: Mapping[str, Sequence], table: str = "") -> DataFrame:
    return column_checks(df, table, accepted=accepted)


def unique_violations(df: DataFrame, column: str | Sequence[str], table: str = "") -> DataFrame:
    cols = [column] if isinstance(column, str) else list(column)
    nn = None
    for c in cols:
        cond = F.col(c).isNotNull()
        nn = cond if nn is None else nn & cond
    dup = df.where(nn).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    return _report(dup.agg(F.count(F.lit(1)).alias("n")), table, ",".join(cols), "unique")


def duplicate_key_rows(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The rows behind a failed ``unique`` check: every row whose non-null key
    occurs more than once (e.g. a dimension whose attributes conflict).  The
    duplicated keys are found on aggregated keys first, then the rows are
    semi-joined to them; a key that many rows share is salted."""
    cols = [key] if isinstance(key, str) else list(key)
    nn = None
    for c in cols:
        cond = F.col(c).isNotNull()
        nn = cond if nn is None else nn & cond
    dups = df.where(nn).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return skew_split_join(df, dups, cols, cols, "left_semi")


def _parent_keys(parent: DataFrame, pk: str, alias: str) -> DataFrame:
    return parent.select(F.col(pk).alias(alias)).where(F.col(alias).isNotNull())


def _orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str,
                 broadcast_rows: int | None = None) -> DataFrame:
    """``(__k, __rows)``: distinct orphan child keys with their row counts.

    Parent keys within the broadcast bound: broadcast anti join (Catalyst then
    anti-joins the raw child rows map-side and aggregates only the orphans).
    Beyond it: child keys are aggregated first (a hot key becomes one row)
    and left-joined to the distinct parent keys, so no raw child row is
    shuffled for the join.
    """
    parent_keys = _parent_keys(parent, pk, "__k")
    keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__k")).agg(
        F.count(F.lit(1)).alias("__rows"))
    if fits_broadcast(parent_keys, broadcast_bound(parent.sparkSession, broadcast_rows), upper_bound_of=parent):
        return keys.join(F.broadcast(parent_keys), "__k", "left_anti")
    found = parent_keys.distinct().select("__k", F.lit(True).alias("__found"))
    return keys.join(found, "__k", "left").where(F.col("__found").isNull()).drop("__found")


def relationship_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str, table: str = "",
                            distinct_keys: bool = False, broadcast_rows: int | None = None) -> DataFrame:
    """Child rows (or, with ``distinct_keys``, distinct child keys) whose
    non-null key is missing from the parent."""
    orphans = _orphan_keys(child, fk, parent, pk, broadcast_rows)
    n = F.count(F.lit(1)) if distinct_keys else F.coalesce(F.sum("__rows"), F.lit(0))
    return _report(orphans.agg(n.alias("n")), table, fk, "relationships")


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str,
                broadcast_rows: int | None = None) -> DataFrame:
    """The child rows themselves whose non-null key has no parent.

    Small parent: broadcast anti join.  Large parent: the orphan *keys* are
    found on pre-aggregated keys first, then the child rows are semi-joined to
    them (usually few, so AQE broadcasts them at run time)."""
    rows = child.where(F.col(fk).isNotNull())
    parent_keys = _parent_keys(parent, pk, "__pk")
    if fits_broadcast(parent_keys, broadcast_bound(parent.sparkSession, broadcast_rows), upper_bound_of=parent):
        pk_b = F.broadcast(parent_keys)
        return rows.join(pk_b, rows[fk] == pk_b["__pk"], "left_anti")
    orphan = _orphan_keys(child, fk, parent, pk, broadcast_rows).select(F.col("__k").alias("__ok"))
    return skew_split_join(rows, orphan, [fk], ["__ok"], "left_semi")


def _is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def accepted_domains(df: DataFrame, columns: Sequence[str] | None = None,
                     max_values: int = MAX_ACCEPTED_VALUES, rsd: float = 0.02) -> DataFrame:
    """``(column_name, accepted_value)``: the full domain of each string column
    with 1..``max_values`` distinct non-null values.

    One HyperLogLog pass (one row to the driver) drops columns that clearly
    have more values, so high-cardinality columns are never shuffled; the
    remaining columns get an exact distinct and an exact domain-size test.
    """
    columns = [c for c in (columns if columns is not None else df.columns) if _is_string(df.schema[c].dataType)]
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column_name string, accepted_value string")
    if not columns:
        return empty
    est = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"__d{i}") for i, c in enumerate(columns)]).first()
    # HyperLogLog is near exact at this size; 4x head room keeps every true small domain.
    short = [c for i, c in enumerate(columns) if 0 < est[f"__d{i}"] <= 4 * max_values]
    if not short:
        return empty
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("accepted_value")) for c in short
    ])).alias("v")).select("v.*").where(F.col("accepted_value").isNotNull()).distinct()
    sizes = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("__n")).where(
        (F.col("__n") >= 1) & (F.col("__n") <= max_values))
    return values.join(F.broadcast(sizes), "column_name", "left_semi")


def domains_of(df: DataFrame, columns: Sequence[str] | None = None,
               max_values: int = MAX_ACCEPTED_VALUES) -> dict[str, list[str]]:
    """Accepted-value lists to the driver (at most ``max_values`` per column)."""
    out: dict[str, list[str]] = {}
    for r in accepted_domains(df, columns, max_values).collect():
        out.setdefault(r["column_name"], []).append(r["accepted_value"])
    return {k: sorted(v) for k, v in out.items()}


def check_report(spec: MartSpec, tables: Mapping[str, DataFrame], built: Mapping[str, DataFrame] | None = None,
                 accepted: Mapping[str, Mapping[str, Sequence]] | None = None) -> DataFrame:
    """Run every check the mart's rules attach, as one report DataFrame.

    Rules: dimension key -> not_null + unique; dimension string attribute with a
    1..10 value domain -> accepted_values; attribute whose source field is
    declared non-nullable -> not_null; fact key -> not_null + relationships to
    every dimension it references; fact metric -> not_null.

    ``built`` supplies already built/published tables by name (otherwise they
    are built here); ``accepted`` supplies accepted-value lists per table and
    column (otherwise they are the full domains of the dimension's sources).
    """
    built = dict(built or {})
    accepted = {k: dict(v) for k, v in (accepted or {}).items()}
    dims = {d.name: built[d.name] if d.name in built else build_dimension(d, tables) for d in spec.dimensions}
    parts: list[DataFrame] = []
    for d in spec.dimensions:
        df = dims[d.name]
        src = tables[d.source_table].schema
        strict = [a for a in d.attribute_columns if a in src.fieldNames() and not src[a].nullable]
        if d.name in accepted:
            dom = accepted[d.name]
        else:
            # from the sources, not from the table under test: a published value that they lack is a violation
            dom = domains_of(build_dimension(d, tables), [a for a in d.attribute_columns])
        cc = column_checks(df, d.name, not_null=[d.key_column] + strict, accepted=dom)
        parts.append(cc)
        parts.append(unique_violations(df, d.key_column, d.name))
    for f in spec.facts:
        df = built.get(f.name)
        if df is None:
            df = build_fact(f, tables, spec)
        keys = fact_keys(f)
        cc = column_checks(df, f.name, not_null=keys + [m.name for m in f.metrics])
        if cc is not None:
            parts.append(cc)
        for key, d in spec.dimensions_of(f):
            parts.append(relationship_violations(df, key, dims[d.name], d.key_column, f.name))
    return _union(parts, next(iter(tables.values())).sparkSession if tables else None)


def refresh_report(fact: Fact, spec: MartSpec, delta: DataFrame, current: DataFrame, dims: Mapping[str, DataFrame],
                   broadcast_rows: int | None = None) -> DataFrame:
    """The fact's part of :func:`check_report` after ``delta`` is merged into ``current``,
    from the touched groups alone.

    ``current`` has passed, so a violation can only be in a group of the delta: a key
    that is NULL or that no dimension row has, or a metric that is NULL in the delta and
    in the group it merges into.  Only the delta's keys meet the dimensions, and only its
    groups with a NULL metric meet the current fact."""
    keys, names = fact_keys(fact), [m.name for m in fact.metrics]
    parts = [c for c in [column_checks(delta, fact.name, not_null=keys)] if c is not None]
    if names:
        some_null = F.lit(False)
        for n in names:
            some_null = some_null | F.col(n).isNull()
        open_ = delta.where(some_null).select(*keys, *[F.col(n).isNull().alias(f"__null_{n}") for n in names])
        if keys:
            known = current.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], *names)
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(k).eqNullSafe(F.col(f"__c{i}"))
            met = open_.join(known, same, "left")  # one row per group on both sides
        else:
            met = open_.crossJoin(F.broadcast(current.select(*names)))  # a single row each
        parts.append(column_checks(met.select(*[F.when(~F.col(f"__null_{n}") | F.col(n).isNotNull(), 1).alias(n) for n in names]), fact.name, not_null=names))
    for key, d in spec.dimensions_of(fact):
        parts.append(relationship_violations(delta, key, dims[d.name], d.key_column, fact.name, broadcast_rows=broadcast_rows))
    return _union(parts, delta.sparkSession)


def failures(report: DataFrame) -> list[dict]:
    """Failed checks to the driver (bounded by the number of checks)."""
    return [r.asDict() for r in report.where(~F.col("passed")).collect()]


__all__ = [
    "REPORT_SCHEMA", "MAX_ACCEPTED_VALUES", "column_checks", "not_null_counts", "accepted_values_counts",
    "unique_violations", "relationship_violations", "orphan_rows", "accepted_domains", "domains_of",
    "check_report", "refresh_report", "failures", "PERIOD",
]
