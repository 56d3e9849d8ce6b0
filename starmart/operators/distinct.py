"""Exact distinct counts that merge: the values of each group as bucketed bitmaps.

A distinct count cannot be added up, but the set behind it can.  Each value becomes a
number; numbers fall into buckets of 32768, and per group and bucket a row holds either
the few positions that occur (``positions``) or, beyond ``FEW`` of them, a bitmap
(``bits``, 4 KB).  So scattered numbers cost a few bytes each and dense ones a bit.
Rolling up to coarser groups and merging new rows are ORs per group and bucket: a group
that holds a third of all rows is spread over its buckets, and no task ever holds more
than one bucket's positions.

Integers, dates, timestamps and decimals of up to 18 digits are their own numbers.
Other values get dense numbers from a table of ids (:func:`value_ids`), which only ever
grows, so sets made before and after a refresh speak of the same numbers.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.operators.facts import fact_keys, fact_rows, key_columns
from starmart.operators.grains import parts
from starmart.plans.joins import row_count, skew_split_join
from starmart.session import ROWS_PER_TASK, dealt, written
from starmart.spec import Fact, MartSpec, Metric

FEW = 512  # positions: 1 KB as shorts
SET_COLUMNS = ("bucket", "positions", "bits")
_IDS_PER_BUCKET = 100_000
_SLICES = 64  # of a bucket, by the position's last bits: at most 512 positions in each


def own_number(column: str, t: T.DataType) -> Column | None:
    """The number that a value is by itself, NULL for NULL; ``None`` if its type has none."""
    c = F.col(column)
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return c.cast("bigint")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    if isinstance(t, T.DecimalType) and t.precision <= 18:
        return (c * F.lit(10**t.scale).cast("decimal(19,0)")).cast("bigint")
    return None


def value_ids(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(value, id)``: ``known`` and, after its largest id, dense ids for the other values.

    Values are dealt by hash into buckets of some 100,000; the buckets' sizes (one row
    each) give where each begins, and inside a bucket values count up in order.  The
    same values always get the same ids, so a recomputed task gives what the lost one gave.
    """
    column = values.columns[0]
    new = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    base = 0
    if known is not None:
        new = new.join(known.select("value"), "value", "left_anti")
        base = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    buckets = new.count() // _IDS_PER_BUCKET + 1
    new = new.withColumn("b", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    sizes = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select("b", (F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + base).alias("begin"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("value"))
    # one row for every 100,000 values
    out = new.join(F.broadcast(begins), "b").select("value", (F.col("begin") + place).alias("id"))
    return out if known is None else known.select("value", "id").unionByName(out)


def _different(rows: DataFrame) -> int:
    """About how many different rows there are: what a grouping by all columns holds."""
    return rows.agg(F.approx_count_distinct(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).first()[0]


def distinct_sets(rows: DataFrame, keys: Sequence[str], number: Column, most: int | None = None) -> DataFrame:
    """Keys, ``bucket``, ``positions``, ``bits``: the sets of ``number`` per group; NULL
    is no value, and a group without values has no row.  ``most``: a bound on the rows, if known."""
    pairs = rows.select(*keys, number.alias("__number")).where(F.col("__number").isNotNull()).select(
        *keys, F.bitmap_bucket_number("__number").alias("bucket"), F.bitmap_bit_position("__number").cast("smallint").alias("position"))
    return _set_rows(pairs, None, [*keys, "bucket"], most)


def merge_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the sets of each group of ``keys``: one row per group and bucket."""
    group = [*keys, "bucket"]
    pairs = sets.select(*group, F.explode("positions").alias("position"))
    bitmaps = sets.where(F.col("bits").isNotNull()).groupBy(*group).agg(F.bitmap_or_agg("bits").alias("bits"))
    return _set_rows(pairs, bitmaps, group)


def _set_rows(pairs: DataFrame, bitmaps: DataFrame | None, group: Sequence[str], most: int | None = None) -> DataFrame:
    """The row of each group from its ``position`` rows and at most one of ``bits``.

    A bitmap takes 4 KB however few bits are set, so only groups that end as one are
    given one; the positions of the others travel as what they are.  Many different
    positions are dealt by group and slice into small tasks before anything is grouped:
    a task that reads a large file (or bucket) would else hold all of its positions."""
    n = 0 if most is not None and most <= ROWS_PER_TASK else _different(pairs)
    if n <= ROWS_PER_TASK:
        parts, listed = pairs.distinct(), F.collect_list("position")
    else:
        by = [*group, "__slice"]
        different = dealt(pairs.withColumn("__slice", F.pmod(F.col("position").cast("int"), F.lit(_SLICES))), n, *by).distinct()
        parts, listed = different.groupBy(*by).agg(F.collect_list("position").alias("slice")).drop("__slice"), F.flatten(F.collect_list("slice"))
    parts = parts.withColumn("bits", F.lit(None).cast("binary")) if bitmaps is None else parts.unionByName(bitmaps, allowMissingColumns=True)
    met = dealt(parts, n, *group).groupBy(*group).agg(listed.alias("positions"), F.collect_list("bits").alias("bits"))
    small = (F.size("bits") == 0) & (F.size("positions") <= FEW)
    few = met.where(small).select(*group, F.array_sort("positions").alias("positions"), F.lit(None).cast("binary").alias("bits"))
    # a group's rows are together already: this grouping moves nothing
    set_bits = met.where(~small).select(*group, F.explode("positions").alias("position")).groupBy(*group).agg(
        F.bitmap_construct_agg(F.col("position").cast("bigint")).alias("bits"))
    had_bits = met.where(~small).select(*group, F.explode("bits").alias("bits"))
    many = set_bits.unionByName(had_bits).groupBy(*group).agg(F.bitmap_or_agg("bits").alias("bits"))
    return few.unionByName(many.select(*group, F.lit(None).cast("array<smallint>").alias("positions"), "bits"))


def count_sets(sets: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys and the size of each group's set, from :func:`merge_sets` of the same keys."""
    size = F.when(F.col("positions").isNotNull(), F.size("positions")).otherwise(F.bitmap_count("bits"))
    n = F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias(name)
    return sets.groupBy(*keys).agg(n) if keys else sets.agg(n)


# -- of a fact's metrics ------------------------------------------------------

def set_metrics(fact: Fact) -> list[Metric]:
    """The exact distinct counts of a column: those that a set keeps."""
    return [m for m in fact.metrics if m.aggregation == "count_distinct" and m.expression is None and not m.approximate]


def metric_sets(fact: Fact, metric: Metric, tables: Mapping[str, DataFrame], spec: MartSpec | None = None,
                known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The sets behind ``metric`` per fact key, and the ids of its values where their
    type needs them (``known`` ones first)."""
    part = next(p for p in parts(fact, tables) if metric in p.fact.metrics)
    rows = fact_rows(part.fact, part.tables)
    keys = fact_keys(fact)
    typed = key_columns(part.fact, rows, part.tables, spec)
    number = own_number(metric.source_column, rows.schema[metric.source_column].dataType)
    most = row_count(part.tables[part.fact.primary_table])  # joins are many-to-one
    if number is not None:
        return distinct_sets(rows.select(*typed, number.alias("__n")), keys, F.col("__n"), most), None
    # few rows per group and value: a value that many rows share is met once per group
    pairs = rows.select(*typed, F.col(metric.source_column).alias("value"))
    n = 0 if most <= ROWS_PER_TASK else _different(pairs)
    pairs = dealt(pairs, n, *pairs.columns).distinct()
    ids = written(value_ids(pairs.select("value"), known), "distinct-ids")
    return distinct_sets(skew_split_join(pairs, ids, ["value"], ["value"], "inner"), keys, F.col("id"), most), ids
