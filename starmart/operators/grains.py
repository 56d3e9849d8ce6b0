"""Facts whose metrics come from tables of different grain.

``SUM(o_totalprice)`` over line items joined to their orders counts an order once
per line.  Here each metric is aggregated over the rows of its own table (its home)
and the aggregates meet by the fact's keys (drill-across): a row of the home table
counts once, with or without rows in the other tables.

A metric's home is the table it names (``Metric.table``), else the primary table if
the metric resolves there, else the one joined table where it does; a metric that
needs columns of several tables lives at the grain of the primary one, whose rows the
joins keep.  From its home a metric must reach every key, the time column and every
filter column, over joins that lead on from there; a fact key on which the primary
table joins the home stands for the home's side of that join.  A metric that cannot is
refused: there is no honest way to split an order's total over its lines' suppliers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.errors import SpecError
from starmart.functions.metrics import aggregate, column_type
from starmart.spec import YEAR_FROM, Fact, Join, Metric


@dataclass(frozen=True)
class Part:
    """The metrics of one home, as a fact of its own."""

    fact: Fact
    tables: Mapping[str, DataFrame]


def resolves(metric: Metric, df: DataFrame) -> bool:
    """Does the metric aggregate columns of ``df`` only?  For an expression Spark's
    analyzer decides on the schema (no job)."""
    if metric.expression is None:
        return metric.source_column is None or metric.source_column in df.columns
    try:
        df.agg(aggregate(metric, df.schema))
        return True
    except AnalysisException:
        return False


def home_of(metric: Metric, fact: Fact, tables: Mapping[str, DataFrame]) -> str:
    """The table at whose grain ``metric`` is aggregated."""
    known = [fact.primary_table, *(j.table for j in fact.joins)]
    if metric.table is not None:
        if metric.table not in known:
            raise SpecError(f"Fact '{fact.name}' metric '{metric.name}' is of table '{metric.table}', which the fact does not read ({known}).")
        if not resolves(metric, tables[metric.table]):
            raise SpecError(f"Fact '{fact.name}' metric '{metric.name}' does not resolve in its table '{metric.table}' "
                            f"(columns: {sorted(tables[metric.table].columns)}).")
        return metric.table
    if not fact.joins or resolves(metric, tables[fact.primary_table]):
        return fact.primary_table
    homes = [t for t in dict.fromkeys(known[1:]) if resolves(metric, tables[t])]
    if len(homes) > 1:
        raise SpecError(f"Fact '{fact.name}' metric '{metric.name}' resolves in several joined tables {homes}; name one as its table.")
    return homes[0] if homes else fact.primary_table


def _onward(fact: Fact, home: str, tables: Mapping[str, DataFrame]) -> tuple[list[Join], list[str]]:
    """The fact's joins that lead on from ``home``, and the columns it reaches with them."""
    reach = list(tables[home].columns)
    joins = []
    for j in fact.joins:
        if j.table != home and all(c in reach for c in j.left_on):
            joins.append(j)
            reach += [c for c in tables[j.table].columns if c not in reach]
    return joins, reach


def _part(fact: Fact, home: str, metrics: Sequence[Metric], tables: Mapping[str, DataFrame], keys: Sequence[str]) -> Part:
    joins, reach = _onward(fact, home, tables)
    # the primary side of the join to the home, told by the home's side
    (to_home,) = [j for j in fact.joins if j.table == home][:1]
    stand_ins = {left: right for left, right in zip(to_home.left_on, to_home.right_on)
                 if left not in reach and column_type(tables[fact.primary_table].schema, left) is not None}
    used = [k for k in keys if k in stand_ins]
    needed = {k: "key" for k in keys}
    needed.update({k: "filter column" for k in fact.filters if k != YEAR_FROM})
    if fact.time_column is not None and (fact.time_grain is not None or YEAR_FROM in fact.filters):
        needed[fact.time_column] = "time column"
    for column, role in needed.items():
        if column not in reach and column not in stand_ins:
            raise SpecError(
                f"Fact '{fact.name}': metrics {[m.name for m in metrics]} are of table '{home}', whose rows do not reach the "
                f"{role} '{column}'; they cannot be placed at this grain. Put them in a fact of their own, or leave '{column}' out.")
    primary = tables[fact.primary_table].schema
    home_rows = tables[home].withColumns({k: F.col(stand_ins[k]).cast(column_type(primary, k)) for k in {*used, *(c for c in needed if c in stand_ins)}})
    sub = replace(fact, source_tables=(home, *(j.table for j in joins)), metrics=tuple(metrics), joins=tuple(joins), dimension_keys=tuple(keys),
                  key_map={k: v for k, v in fact.key_map.items() if k in keys},
                  time_column=fact.time_column if fact.time_column in reach or fact.time_column in stand_ins else None)
    return Part(sub, {**tables, home: home_rows})


def parts(fact: Fact, tables: Mapping[str, DataFrame], keys: Sequence[str] | None = None) -> list[Part]:
    """``fact`` by home table, the primary one first; one part if no metric lives elsewhere.

    ``keys``: the fact keys that the result needs (all by default)."""
    keys = tuple(fact.dimension_keys if keys is None else keys)
    homes: dict[str, list[Metric]] = {}
    for m in fact.metrics:
        homes.setdefault(home_of(m, fact, tables), []).append(m)
    if set(homes) <= {fact.primary_table}:
        return [Part(fact, tables)]
    own = homes.pop(fact.primary_table, None)
    first = [Part(replace(fact, metrics=tuple(own)), tables)] if own else []
    return first + [_part(fact, home, ms, tables, keys) for home, ms in homes.items()]


def drill_across(results: Sequence[DataFrame], keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Results with the same keys as one: a row per key found in any of them.

    Each result has one row per key, so a key that many source rows hold is a few
    rows here.  NULL keys meet each other.  Where a result lacks a key its counts are
    0 and its other metrics NULL.
    """
    both = results[0]
    for r in results[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    names = [c for c in both.columns if c not in keys]
    counts = {m.name for m in metrics if m.aggregation in ("count", "count_distinct")}
    merged = [F.max(c).alias(c) for c in names]  # at most one row of a key has a value
    out = both.groupBy(*keys).agg(*merged) if keys else both.agg(*merged)
    order = [m.name for m in metrics]
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in counts else F.col(c) for c in order],
                      *[c for c in names if c not in order])

