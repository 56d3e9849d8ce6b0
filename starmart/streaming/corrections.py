"""Corrections and deletions: signed deltas of a published fact.

A corrected source row is a deletion and an insertion.  :func:`correct_fact` aggregates
both sides with the fact's own definition and adds the one and subtracts the other per
group.  Counts, exact sums (integers, decimals) and averages of them follow from signed
states; a kept number of rows per group tells when a group is gone.  What signs cannot
tell is recomputed from the source as it stands after the change, for those groups only:

* a smallest or largest value that the deletions reach (another row may hold it, or not);
* a sum that comes out as 0 after a deletion (it may be NULL now);
* distinct counts, sums of DOUBLE columns and expressions that do not add up, in groups
  that gain or lose rows.

Deleting rows that the fact does not hold fails the job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.errors import SpecError
from starmart.functions.metrics import average_total, ratio, raw_aggregate, state_name, target_type
from starmart.operators.facts import aggregate_rows, build_fact, fact_keys, fact_rows
from starmart.operators.grains import home_of
from starmart.plans.joins import broadcast_bound, fits_broadcast
from starmart.session import written
from starmart.sinks.publish import write_table
from starmart.spec import Fact, MartSpec, Metric

SUPPORT = "__support"  # rows behind a group


def _supported(fact: Fact) -> Fact:
    return fact if any(m.name == SUPPORT for m in fact.metrics) else replace(fact, metrics=(*fact.metrics, Metric(SUPPORT, "count")))


def write_correctable_fact(fact: Fact, tables: Mapping[str, DataFrame], path: str, spec: MartSpec | None = None) -> DataFrame:
    """A first version that corrections can work on: with states and the rows behind each group."""
    write_table(build_fact(_supported(fact), tables, spec, states=True), path)
    return next(iter(tables.values())).sparkSession.read.parquet(path)


@dataclass(frozen=True)
class _Signed:
    """How a metric's columns follow from signed rows, and when they cannot."""

    columns: dict[str, Column]  # over the grouped rows: signed parts 0 (current), 1 (inserted), 2 (deleted)
    unclear: Column


def _signed_sum(name: str, t: T.DataType) -> Column:
    return F.sum(F.col(name).cast(t) * F.col("__sign"))


def _signed(metric: Metric, rows: DataFrame) -> _Signed:
    name, agg = metric.name, metric.aggregation
    lost, touched = F.coalesce(F.max(F.col("__sign") < 0), F.lit(False)), F.max(F.col("__part") > 0)
    if agg == "count" and (metric.expression is None or metric.is_additive):
        return _Signed({name: _signed_sum(name, T.LongType()).cast("bigint")}, F.lit(False))
    if agg in ("min", "max") and (metric.expression is None or metric.is_additive):
        best = getattr(F, agg)
        kept, gone = best(F.when(F.col("__sign") > 0, F.col(name))), best(F.when(F.col("__sign") < 0, F.col(name)))
        reached = gone <= kept if agg == "min" else gone >= kept
        return _Signed({name: kept}, F.coalesce(reached, F.lit(False)))
    if agg == "sum" and metric.is_additive:
        exact = rows.agg(raw_aggregate(metric).alias("x")).schema["x"].dataType
        if isinstance(exact, (T.DecimalType, T.LongType)):
            scale = exact.scale if isinstance(exact, T.DecimalType) else 0
            total = _signed_sum(name, T.DecimalType(38 - 1, scale))
            return _Signed({name: total.cast(target_type(metric, rows.schema))}, lost & F.coalesce(total == 0, F.lit(True)))
    if agg == "avg" and metric.expression is None:
        s, n = state_name(metric, "s"), state_name(metric, "n")
        exact = rows.agg(average_total(metric.source_column, rows.schema).alias("x")).schema["x"].dataType
        if isinstance(exact, T.DecimalType):
            count = _signed_sum(n, T.LongType())
            # no value left: the sum of none is NULL
            total = F.when(count > 0, _signed_sum(s, T.DecimalType(37, exact.scale)).cast(exact))
            return _Signed({name: ratio(total, count), s: total, n: count.cast("bigint")}, F.lit(False))
    # no signs: the current columns stand, unless rows came or went
    states = [name, *(state_name(metric, p) for p in ("s", "n", "hll"))]
    return _Signed({c: F.max(F.when(F.col("__part") == 0, F.col(c))) for c in states}, touched)


def correct_fact(fact: Fact, current_path: str, inserted: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame],
                 after: Mapping[str, DataFrame], new_path: str, spec: MartSpec | None = None, broadcast_rows: int | None = None) -> DataFrame:
    """The fact at ``current_path`` (see :func:`write_correctable_fact`) less the rows of
    ``deleted`` and with those of ``inserted``, written to ``new_path``.

    Each mapping has the primary table's rows and all of the joined tables; ``after`` is
    the source after the change, read for the groups that signs leave unclear only."""
    full = _supported(fact)
    spark = next(iter(after.values())).sparkSession
    away = [m.name for m in fact.metrics if home_of(m, fact, after) != fact.primary_table]
    if away:
        raise SpecError(f"Fact '{fact.name}' cannot be corrected by rows of '{fact.primary_table}': metrics {away} are of joined tables.")
    keys = fact_keys(full)
    rows = fact_rows(full, after, split_hot=False)  # types only
    current = spark.read.parquet(current_path)
    if SUPPORT not in current.columns:
        raise SpecError(f"Fact '{fact.name}' at {current_path} does not keep the rows behind its groups; write it with write_correctable_fact.")
    parts = [current] + [build_fact(full, t, spec, states=True) for t in (inserted, deleted)]
    both = None
    for i, p in enumerate(parts):
        p = p.select(*current.columns).withColumns({"__part": F.lit(i), "__sign": F.lit(-1 if i == 2 else 1)})
        both = p if both is None else both.unionByName(p)
    how = [_signed(m, rows) for m in full.metrics]
    unclear = F.lit(False)
    for h in how:
        unclear = unclear | h.unclear
    columns = [c.alias(n) for h in how for n, c in h.columns.items() if n in current.columns]
    merged = both.groupBy(*keys).agg(*columns, unclear.alias("__unclear")) if keys else both.agg(*columns, unclear.alias("__unclear"))
    missing = F.raise_error(F.lit(f"fact '{fact.name}': more rows deleted than a group has")).cast("boolean")
    merged = written(merged.where(F.when(F.col(SUPPORT) < 0, missing).otherwise(F.col(SUPPORT) > 0)), "corrected")
    again = merged.where("__unclear").select(*keys)
    kept = merged.where("not __unclear").drop("__unclear")
    if keys:
        wanted = again.select(*[F.col(k).alias(f"__w{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__w{i}"))
        raw = fact_rows(full, after)
        if fits_broadcast(wanted, broadcast_bound(spark, broadcast_rows)):
            fresh = aggregate_rows(full, raw.join(F.broadcast(wanted), same, "left_semi"), after, spec, states=True)
        else:  # many groups: aggregate first, so that no group's rows meet in a join
            fresh = aggregate_rows(full, raw, after, spec, states=True).join(wanted, same, "left_semi")
    else:
        fresh = aggregate_rows(full, fact_rows(full, after), after, spec, states=True)
        fresh = fresh if again.count() else fresh.limit(0)
    write_table(kept.unionByName(fresh.select(*kept.columns)), new_path)
    return spark.read.parquet(new_path)

