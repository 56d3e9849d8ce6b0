"""Fact builds: ``SELECT keys, metrics FROM rows GROUP BY keys``.

``fact_rows`` is the row-level input of a fact: the primary source, filtered
(fixed equality conditions and ``year_from``), joined many-to-one with the
declared secondary sources, with a ``period`` column when a time grain is set.
``build_fact`` groups it (partial aggregation happens map-side, so a hot key is
collapsed before the shuffle); metric results are cast to their conformed
types, and fact keys to the type of the dimension key they reference.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.errors import AnalysisException

from starmart.errors import SpecError
from starmart.functions.grain import PERIOD, period
from starmart.functions.metrics import aggregate, column_type, decompose, decomposable, published_states
from starmart.operators.grains import drill_across, parts, resolves
from starmart.plans.joins import _row_hash, broadcast_bound, fits_broadcast, many_to_one, row_count
from starmart.session import ROWS_PER_TASK, dealt
from starmart.spec import YEAR_FROM, Fact, MartSpec, validate_fact


def apply_filters(df: DataFrame, filters: Mapping[str, str], time_column: str | None) -> DataFrame:
    """Fixed conditions: ``column == value`` (value cast to the column type) and
    ``year_from`` (lower bound on the year of the time column).

    ``year_from`` is written as a range on the raw column, so Parquet receives it
    as a pushed filter instead of a function of the column.
    """
    for key, value in filters.items():
        if key == YEAR_FROM:
            if time_column is None:
                raise SpecError(f"filter '{YEAR_FROM}' needs a time column.")
            year = int(value)
            t = column_type(df.schema, time_column)
            col = F.col(time_column)
            # String literals cast to the column type: independent of time zones.
            if isinstance(t, T.TimestampNTZType):
                df = df.where(col >= F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz"))
            elif isinstance(t, T.DateType):
                df = df.where(col >= F.lit(f"{year:04d}-01-01").cast("date"))
            elif isinstance(t, T.TimestampType):
                # midnight in the session's zone, where year(col) would change too
                df = df.where(col >= F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp"))
            else:
                df = df.where(F.year(col) >= year)
        else:
            t = column_type(df.schema, key)
            if t is None:
                raise SpecError(f"filter column '{key}' does not exist. Available columns: {sorted(df.columns)}.")
            df = df.where(F.col(key) == F.lit(value).cast(t))
    return df


def read_columns(fact: Fact, df: DataFrame) -> list[str]:
    """Columns of ``df`` that the rows of ``fact`` are made from (any that an expression
    names, perhaps some more)."""
    named = {*fact.dimension_keys, *fact.filters, fact.time_column, *(c for j in fact.joins for c in j.left_on), *(m.source_column for m in fact.metrics)}
    expressions = [m.expression.lower() for m in fact.metrics if m.expression]
    return [c for c in df.columns if c in named or any(c.lower() in e for e in expressions)]


def fact_rows(fact: Fact, tables: Mapping[str, DataFrame], broadcast_rows: int | None = None,
              split_hot: bool = True) -> DataFrame:
    """Filtered, joined source rows of ``fact``, with ``period`` if it has a grain.

    ``split_hot=False`` builds the plan without the hot-key detection jobs
    (for analysis only)."""
    validate_fact(fact, tables)
    primary = tables[fact.primary_table]
    here = set(primary.columns)
    early = {k: v for k, v in fact.filters.items()
             if (k == YEAR_FROM and fact.time_column in here) or k in here}
    late = {k: v for k, v in fact.filters.items() if k not in early}
    df = apply_filters(primary, early, fact.time_column)
    for j in fact.joins:
        df = many_to_one(df, tables[j.table], j.left_on, j.right_on, j.how,
                         what=f"fact '{fact.name}' source '{j.table}'", broadcast_rows=broadcast_rows,
                         split_hot=split_hot, salt_by=read_columns(fact, df))
    df = apply_filters(df, late, fact.time_column)
    if fact.time_grain is not None:
        df = df.withColumn(PERIOD, period(fact.time_column, fact.time_grain))
    return df


def fact_keys(fact: Fact) -> list[str]:
    return ([PERIOD] if fact.time_grain is not None else []) + list(fact.dimension_keys)


def key_columns(fact: Fact, rows: DataFrame, tables: Mapping[str, DataFrame], spec: MartSpec | None):
    """Key columns, each cast to the type of the dimension key it references."""
    key_type: dict[str, T.DataType] = {}
    if spec is not None:
        for key, dim in spec.dimensions_of(fact):
            t = column_type(tables[dim.source_table].schema, dim.key_column)
            key_type.setdefault(key, t)
    cols = []
    for k in fact_keys(fact):
        t = key_type.get(k)
        if t is not None and t != column_type(rows.schema, k):
            cols.append(F.col(k).cast(t).alias(k))
        else:
            cols.append(F.col(k))
    return cols


def _preaggregated(fact: Fact, tables: Mapping[str, DataFrame], spec: MartSpec | None,
                   broadcast_rows: int | None, split_hot: bool = True) -> DataFrame | None:
    """Multi-source fact whose secondary side is too large to broadcast:
    aggregate the primary rows to (primary keys, join keys) partial states
    first - a hot join key becomes one row per group before any shuffle - then
    join and merge.  ``None`` when the metrics do not allow it."""
    primary = tables[fact.primary_table]
    here = set(primary.columns)
    if not fact.metrics or not all(decomposable(m) and resolves(m, primary) for m in fact.metrics):
        return None
    bound = broadcast_bound(primary.sparkSession, broadcast_rows)
    if all(fits_broadcast(tables[j.table], bound) for j in fact.joins):
        return None  # broadcast joins stream the rows; nothing to gain
    rows = fact_rows(fact, tables, broadcast_rows, split_hot=False)  # types of the full rows (analysis only)
    split = [decompose(m, rows.schema) for m in fact.metrics]
    early = {k: v for k, v in fact.filters.items()
             if (k == YEAR_FROM and fact.time_column in here) or k in here}
    late = {k: v for k, v in fact.filters.items() if k not in early}
    pre = apply_filters(primary, early, fact.time_column)
    period_early = fact.time_grain is not None and fact.time_column in here
    if period_early:
        pre = pre.withColumn(PERIOD, period(fact.time_column, fact.time_grain))
    group = [k for k in fact_keys(fact) if k in pre.columns]
    group += [c for j in fact.joins for c in j.left_on if c in here and c not in group]
    group += [c for p in split for c in p.extra_keys if c not in group]
    pre = pre.groupBy(*group).agg(*[s for p in split for s in p.states])
    for j in fact.joins:
        # one row per join key has no hot key; beside other keys a join key may still repeat
        pre = many_to_one(pre, tables[j.table], j.left_on, j.right_on, j.how,
                          what=f"fact '{fact.name}' source '{j.table}'", broadcast_rows=broadcast_rows,
                          split_hot=split_hot and set(group) != set(j.left_on))
    pre = apply_filters(pre, late, fact.time_column)
    if fact.time_grain is not None and not period_early:
        pre = pre.withColumn(PERIOD, period(fact.time_column, fact.time_grain))
    keys = key_columns(fact, rows, tables, spec)
    merges = [m for p in split for m in p.merges]
    merged = pre.groupBy(*keys).agg(*merges) if keys else pre.agg(*merges)
    return merged.select(*fact_keys(fact), *[p.finish for p in split])


def check_metric_expressions(fact: Fact, rows: DataFrame) -> None:
    """Every metric must analyse against the fact's rows (schema only, no job);
    the first failure raises ``SpecError`` naming fact, metric and expression."""
    for m in fact.metrics:
        try:
            rows.agg(aggregate(m, rows.schema))
        except AnalysisException as e:
            raise SpecError(
                f"Fact '{fact.name}' metric '{m.name}' ({m.expression or m.aggregation}) does not resolve "
                f"against its rows: {str(e).splitlines()[0]} Available columns: {sorted(rows.columns)}."
            ) from None


def _keys_typed_alike(results: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """The first result's key types for all (a key may come from either side of a join)."""
    types = {k: results[0].schema[k].dataType for k in keys}
    return results[:1] + [r.withColumns({k: F.col(k).cast(t) for k, t in types.items() if r.schema[k].dataType != t}) for r in results[1:]]


def build_fact(fact: Fact, tables: Mapping[str, DataFrame], spec: MartSpec | None = None,
               broadcast_rows: int | None = None, split_hot: bool = True, states: bool = False) -> DataFrame:
    """Keys first, then metrics in order (and with ``states`` the columns that make
    averages and approximate distinct counts mergeable later).

    No keys -> one grand-total row; no metrics -> distinct key combinations.
    NULL keys form their own group and NULL metric results stay NULL (the checks
    report both; rows are never dropped).  A multi-source fact whose secondary
    side exceeds the broadcast bound is aggregated before its shuffle join.
    Metrics of a joined table are aggregated at that table's grain (``grains``).
    """
    if spec is not None:
        validate_fact(fact, tables, spec)
    grains = parts(fact, tables)
    if len(grains) > 1 or grains[0].fact is not fact:
        built = [build_fact(p.fact, p.tables, spec, broadcast_rows, split_hot, states) for p in grains]
        return drill_across(_keys_typed_alike(built, fact_keys(fact)), fact_keys(fact), fact.metrics)
    check_metric_expressions(fact, fact_rows(fact, tables, broadcast_rows=0, split_hot=False))
    if fact.joins and not states:
        pre = _preaggregated(fact, tables, spec, broadcast_rows, split_hot)
        if pre is not None:
            return pre
    return aggregate_rows(fact, fact_rows(fact, tables, broadcast_rows, split_hot=split_hot), tables, spec, states)


def aggregate_rows(fact: Fact, rows: DataFrame, tables: Mapping[str, DataFrame], spec: MartSpec | None = None, states: bool = False) -> DataFrame:
    """The fact of some of its rows (:func:`fact_rows`)."""
    keys = key_columns(fact, rows, tables, spec)
    metrics = [aggregate(m, rows.schema) for m in fact.metrics]
    if states:
        rows = _dealt_rows(fact, rows, tables)
        metrics += [c for m in fact.metrics for c in published_states(m, rows.schema)]
    if not metrics:
        if not keys:
            raise SpecError(f"Fact '{fact.name}' has neither keys nor metrics.")
        return rows.select(*keys).distinct()
    if not keys:
        return rows.agg(*metrics)
    return rows.groupBy(*keys).agg(*metrics)


def _dealt_rows(fact: Fact, rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``rows`` in small tasks if they form many groups and no join's exchange has dealt them:
    a task that reads a large file would else hold all groups of it."""
    if fact.joins or row_count(tables[fact.primary_table]) <= ROWS_PER_TASK:
        return rows
    counted = [m.source_column for m in fact.metrics if m.aggregation == "count_distinct" and m.expression is None and not m.approximate]
    group = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*fact_keys(fact), *counted])])
    groups = rows.agg(F.approx_count_distinct(group)).first()[0] if fact_keys(fact) or counted else 0
    return rows if groups <= ROWS_PER_TASK else dealt(rows, row_count(tables[fact.primary_table]), _row_hash(rows, read_columns(fact, rows)))


def build_fact_states(fact: Fact, tables: Mapping[str, DataFrame], broadcast_rows: int | None = None) -> DataFrame:
    """The fact as exact partial states (for rolling up to coarser grains).

    Sums keep their input type (e.g. DECIMAL), averages keep (sum, count) and a
    count-distinct argument stays a key, so any coarser grain is exact.
    """
    grains = parts(fact, tables)
    if len(grains) > 1 or grains[0].fact is not fact:
        built = _keys_typed_alike([build_fact_states(p.fact, p.tables, broadcast_rows) for p in grains], fact_keys(fact))
        out = built[0]
        for b in built[1:]:  # a state that a table does not have is NULL, which adds nothing to a merge
            out = out.unionByName(b, allowMissingColumns=True)
        return out
    rows = fact_rows(fact, tables, broadcast_rows)
    split = [decompose(m, rows.schema) for m in fact.metrics]
    keys = fact_keys(fact)
    for p in split:
        keys += [k for k in p.extra_keys if k not in keys]
    states = [s for p in split for s in p.states]
    if not states:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*states) if keys else rows.agg(*states)


def build_all_facts(spec: MartSpec, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {f.name: build_fact(f, tables, spec) for f in spec.facts}
