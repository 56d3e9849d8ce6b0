"""Metric compilation: aggregate columns, result-type conformance, partial states.

Three forms of every metric:

* ``aggregate(metric, schema)`` – one aggregate column over source rows, cast to
  the conformed type (sum/avg -> double, count/count_distinct -> bigint,
  min/max -> type of the source column).
* ``states(metric)`` / ``merges(metric)`` / ``finish(metric, schema)`` – the
  decomposed form used to aggregate *before* a shuffle join or to roll a fact up
  to a coarser grain: partial states over rows, a merge of states, and the
  final conformed value.  Sums keep the exact type of their input (e.g.
  DECIMAL) until ``finish`` so that re-aggregation is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.errors import NonAdditiveMetricError
from starmart.spec import Metric

# Result type per aggregation (min/max inherit the column type).
AGGREGATION_TYPE = {
    "sum": T.DoubleType(),
    "count": T.LongType(),
    "count_distinct": T.LongType(),
    "avg": T.DoubleType(),
    "min": T.DoubleType(),
    "max": T.DoubleType(),
}

_STATE_SEP = "__"


def column_type(schema: T.StructType, name: str | None) -> T.DataType | None:
    if name is None:
        return None
    for f in schema.fields:
        if f.name == name:
            return f.dataType
    return None


def target_type(metric: Metric, schema: T.StructType) -> T.DataType | None:
    """Conformed result type; ``None`` means "leave the expression's type"."""
    if metric.aggregation in ("min", "max"):
        src = column_type(schema, metric.source_column)
        if src is not None:
            return src
        # Expression-only min/max: the expression decides its type.
        return None if metric.expression is not None else AGGREGATION_TYPE[metric.aggregation]
    return AGGREGATION_TYPE[metric.aggregation]


def raw_aggregate(metric: Metric) -> Column:
    """The aggregate over source rows, before type conformance."""
    if metric.expression is not None:
        return F.expr(metric.expression)
    agg = metric.aggregation
    if agg == "count":
        return F.count(F.lit(1)) if metric.source_column is None else F.count(F.col(metric.source_column))
    c = F.col(metric.source_column)
    if metric.approximate:
        return F.hll_sketch_estimate(F.hll_sketch_agg(c, metric.lg_config_k))
    if agg == "avg":
        raise ValueError("an average depends on its column's type; see average()")
    return {
        "sum": F.sum,
        "count_distinct": F.count_distinct,
        "min": F.min,
        "max": F.max,
    }[agg](c)


def average_total(column: str, schema: T.StructType) -> Column:
    """The sum an average is made of: exact for integers (their sum may leave
    BIGINT) and decimals, DOUBLE otherwise."""
    c = F.col(column)
    t = column_type(schema, column)
    return F.sum(c.cast(T.DecimalType(38, 0)) if isinstance(t, T.IntegralType) else c)


def ratio(total: Column, n: Column) -> Column:
    """An average from its sum and count: the same DOUBLE whether both come from
    rows or from merged partial states."""
    return total.cast("double") / F.nullif(n, F.lit(0))


def conform(col: Column, metric: Metric, schema: T.StructType) -> Column:
    t = target_type(metric, schema)
    return (col.cast(t) if t is not None else col).alias(metric.name)


def aggregate(metric: Metric, schema: T.StructType) -> Column:
    """Aggregate column over source rows, typed and aliased."""
    if metric.aggregation == "avg" and metric.expression is None:
        c = metric.source_column
        return conform(ratio(average_total(c, schema), F.count(F.col(c))), metric, schema)
    return conform(raw_aggregate(metric), metric, schema)


# ---------------------------------------------------------------------------
# Decomposed form
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Decomposition:
    """States over rows, their merge, and the final value, for one metric."""

    states: tuple[Column, ...]
    merges: tuple[Column, ...]
    finish: Column
    # Columns that must become grouping keys of the partial aggregate
    # (count_distinct keeps its argument so the distinct set survives).
    extra_keys: tuple[str, ...] = ()


def state_name(metric: Metric, part: str) -> str:
    return f"{metric.name}{_STATE_SEP}{part}"


def decomposable(metric: Metric) -> bool:
    if metric.expression is None:
        return True
    return metric.is_additive and metric.aggregation in ("sum", "count", "min", "max")


def decompose(metric: Metric, schema: T.StructType) -> Decomposition:
    """Split a metric into partial states that merge exactly.

    sum/count -> summed; min/max -> min/max; avg -> (sum, count);
    count_distinct -> its argument becomes a key of the partial aggregate.
    Non-additive expression metrics raise ``NonAdditiveMetricError``.
    """
    agg = metric.aggregation
    if metric.expression is not None:
        if not decomposable(metric):
            raise NonAdditiveMetricError(
                f"Metric '{metric.name}' ({metric.expression}) is not declared additive; "
                f"it cannot be computed from partial aggregates."
            )
        s = state_name(metric, "s")
        merge = F.sum(s) if agg in ("sum", "count") else getattr(F, agg)(s)
        return Decomposition(
            states=(F.expr(metric.expression).alias(s),),
            merges=(merge.alias(s),),
            finish=conform(F.col(s), metric, schema),
        )
    src = metric.source_column
    if agg in ("sum", "min", "max"):
        s = state_name(metric, "s")
        fn = getattr(F, agg)
        return Decomposition((fn(F.col(src)).alias(s),), (fn(s).alias(s),), conform(F.col(s), metric, schema))
    if agg == "count":
        s = state_name(metric, "n")
        row = F.count(F.lit(1)) if src is None else F.count(F.col(src))
        return Decomposition((row.alias(s),), (F.sum(s).alias(s),), conform(F.col(s), metric, schema))
    if agg == "avg":
        s, n = state_name(metric, "s"), state_name(metric, "n")
        return Decomposition(
            states=(average_total(src, schema).alias(s), F.count(F.col(src)).alias(n)),
            merges=(F.sum(s).alias(s), F.sum(n).alias(n)),
            finish=conform(ratio(F.col(s), F.col(n)), metric, schema),
        )
    if metric.approximate:
        # a mergeable HLL sketch: states union, no extra key needed
        h = state_name(metric, "hll")
        return Decomposition(
            states=(F.hll_sketch_agg(F.col(src), metric.lg_config_k).alias(h),),
            merges=(F.hll_union_agg(h).alias(h),),
            finish=conform(F.hll_sketch_estimate(F.col(h)), metric, schema),
        )
    # count_distinct: keep the argument as a key; count it in the merge.
    d = state_name(metric, "d")
    return Decomposition(
        states=(),
        merges=(F.count_distinct(F.col(src)).alias(d),),
        finish=conform(F.col(d), metric, schema),
        extra_keys=(src,),
    )


def published_states(metric: Metric, schema: T.StructType) -> list[Column]:
    """State columns stored beside a published metric that cannot be merged from its
    value: sum and count of an average, the sketch of an approximate distinct count."""
    if metric.expression is None and (metric.aggregation == "avg" or metric.approximate):
        return list(decompose(metric, schema).states)
    return []


def merge_published(metric: Metric, rows, columns) -> list[Column]:
    """Merge a published metric: from its state columns where it has them (which
    are merged too), else from its value (:func:`merge_for_published`)."""
    if rows is not None and metric.expression is None and (metric.aggregation == "avg" or metric.approximate):
        d = decompose(metric, rows.schema)
        part = "hll" if metric.approximate else "s"
        if state_name(metric, part) in columns:
            if metric.approximate:
                value = F.hll_sketch_estimate(F.hll_union_agg(state_name(metric, "hll")))
            else:
                value = ratio(F.sum(state_name(metric, "s")), F.sum(state_name(metric, "n")))
            return [conform(value, metric, rows.schema), *d.merges]
    return [merge_for_published(metric, rows)]


def merge_for_published(metric: Metric, rows=None) -> Column:
    """Re-aggregate an already conformed (published) metric column.

    sum/count add up, min/max take the extreme; avg and count_distinct raise.
    When ``rows`` (any row-level input of the fact; used for types only, no
    job) shows that the sum expression is DECIMAL(p, s), the published DOUBLE
    values are merged as DECIMAL(38, s).  A DOUBLE holds about 15 digits: up to
    there it converts back to the DECIMAL it came from and the merge is exact.
    """
    agg = metric.aggregation
    if agg in ("avg", "count_distinct") or not metric.is_additive:
        raise NonAdditiveMetricError(
            f"Metric '{metric.name}' ({agg}) is not additive and was published without states; recompute it "
            f"from the source, or publish it with them (averages, approximate distinct counts)."
        )
    c = F.col(metric.name)
    if agg == "sum":
        exact = rows.agg(raw_aggregate(metric)).schema.fields[0].dataType if rows is not None else None
        merged = F.sum(c.cast(T.DecimalType(38, exact.scale))) if isinstance(exact, T.DecimalType) else F.sum(c)
    elif agg == "count":
        merged = F.sum(c)
    else:
        merged = getattr(F, agg)(c)
    t = target_type(metric, rows.schema) if rows is not None else AGGREGATION_TYPE.get(agg)
    if agg in ("min", "max") and rows is None:
        t = None
    return (merged.cast(t) if t is not None else merged).alias(metric.name)
