"""Profiling: column catalog, row counts, column profiles, samples, candidate keys.

Counts and samples are one pass per table; exact distinct counts are one
column-pruned aggregate per column, all in one job, or one HyperLogLog pass at
the caller's choice.  No input row is repeated per column.
"""

from __future__ import annotations

import math
import re
from itertools import combinations
from typing import Iterable, Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.spec import table_columns

CATALOG_SCHEMA = "table_name string, ordinal int, column_name string, data_type string, is_nullable boolean"


def _spark(tables: Mapping[str, DataFrame]):
    for name in tables:
        return tables[name].sparkSession
    raise ValueError("no tables")


def catalog_columns(tables: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> DataFrame:
    """One row per column, in table-name then ordinal order (ordinal from 1)."""
    names = sorted(names if names is not None else tables)
    rows = []
    for t in names:
        table_columns(tables, t, "catalog")
        for i, f in enumerate(tables[t].schema.fields, start=1):
            rows.append((t, i, f.name, f.dataType.simpleString(), bool(f.nullable)))
    spark = _spark(tables)
    return spark.createDataFrame(rows, CATALOG_SCHEMA).orderBy("table_name", "ordinal")


def row_counts(tables: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """``(table_name, row_count)``; all tables counted in one job (Parquet counts
    come from footers, no column is read)."""
    parts = [tables[n].agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(n).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, table_name: str | None = None,
                    exact: bool = True, rsd: float = 0.02) -> DataFrame:
    """``(table_name, column_name, row_count, null_count, distinct_count)`` for
    each column.

    Exact: one two-stage aggregate per column, each reading its column only (rows
    per value first, so a value that many rows hold is one row per task; no row
    is repeated per column).  Otherwise one pass with a sketch per column."""
    columns = list(columns if columns is not None else df.columns)
    if exact:
        out = None
        for c in columns:
            per_value = df.groupBy(compact(F.col(c), df.schema[c].dataType.simpleString()).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            part = per_value.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
                F.count("v").alias("distinct_count"),
            ).select(F.lit(table_name).cast("string").alias("table_name"), F.lit(c).alias("column_name"),
                     "row_count", "null_count", "distinct_count")
            out = part if out is None else out.unionByName(part)
        return out
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(F.col(c)).alias(f"__nn{i}"), F.approx_count_distinct(F.col(c), rsd).alias(f"__d{i}")]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("__rows").alias("row_count"),
            (F.col("__rows") - F.col(f"__nn{i}")).alias("null_count"),
            F.col(f"__d{i}").cast("bigint").alias("distinct_count"),
        ) for i, c in enumerate(columns)
    ])).alias("p")
    return wide.select(stacked).select(F.lit(table_name).cast("string").alias("table_name"), "p.*")


def _k_smallest_per_partition(columns: Sequence[str], k: int):
    """mapInPandas body: the k smallest distinct non-null strings of each column
    in this partition (Python compares code points, i.e. UTF-8 byte order, the
    same order Spark sorts strings in)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        best = {c: np.array([], dtype=object) for c in columns}
        for pdf in batches:
            for i, c in enumerate(columns):
                vals = pdf.iloc[:, i].dropna().to_numpy(dtype=object)
                if len(best[c]) == k:
                    vals = vals[vals < best[c][-1]]
                if len(vals):
                    best[c] = np.unique(np.concatenate([best[c], vals]))[:k]
        out = [(c, v) for c in columns for v in best[c]]
        if out:
            yield pd.DataFrame(out, columns=["column_name", "sample_value"])

    return run


def sample_values(df: DataFrame, columns: Sequence[str], k: int = 5, table_name: str | None = None) -> DataFrame:
    """At most ``k`` distinct non-null values per column, as strings.

    The k smallest values (string order) are taken, so the result is
    deterministic.  Each task first keeps only its own k smallest distinct
    values per column (``mapInPandas`` over Arrow batches, values cast to
    string in the JVM), so at most k x columns rows per partition are shuffled
    however large or skewed the column is; the global k smallest are always
    among them.  The final top-k is a row_number filter (partial per-partition
    limit, then one small window).
    """
    columns = list(columns)
    strings = df.select(*[F.col(c).cast("string").alias(f"__v{i}") for i, c in enumerate(columns)])
    local = strings.mapInPandas(_k_smallest_per_partition(columns, k), "column_name string, sample_value string")
    distinct = local.distinct()
    w = Window.partitionBy("column_name").orderBy("sample_value")
    out = distinct.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
    if table_name is not None:
        out = out.select(F.lit(table_name).alias("table_name"), "*")
    return out


# Texts beyond this many bytes are compared by their SHA-256.
LONG_VALUE = 32


def value_family(t: T.DataType) -> str:
    """The type in which values of different columns are compared."""
    if isinstance(t, T.IntegralType):
        return "bigint"
    if isinstance(t, T.DecimalType):
        return "decimal(38,0)" if t.scale == 0 else t.simpleString()
    return t.simpleString()


def compact(value: Column, family: str) -> Column:
    """``value`` to group by: a long text or binary as its SHA-256 behind a byte that no
    UTF-8 text has, so whole texts are never shuffled; others as they are."""
    if not family.startswith(("string", "binary", "varchar", "char")):
        return value
    raw = value.cast("binary")
    return F.when(F.octet_length(value) > LONG_VALUE, F.concat(F.lit(bytearray(b"\xff")), F.unhex(F.sha2(raw, 256)))).otherwise(raw)


def _key_report(tables: Mapping[str, DataFrame], sets: Sequence[tuple[str, Sequence[str]]]) -> DataFrame | None:
    """``(i, is_key)`` of each set whose table has rows.

    Sets of the same types share one grouping by (set, value), so its exchanges do not
    grow in number with the sets; it is map-side combined, so a value held by a third of
    the rows collapses before the shuffle."""
    by_type: dict[tuple[str, ...], DataFrame] = {}
    for i, (table, columns) in enumerate(sets):
        df = tables[table]
        families = tuple(value_family(df.schema[c].dataType) for c in columns)
        some_null = F.lit(False)
        for c in columns:
            some_null = some_null | F.col(f"`{c}`").isNull()
        values = [compact(F.col(f"`{c}`").cast(f), f).alias(f"v{n}") for n, (c, f) in enumerate(zip(columns, families))]
        rows = df.select(F.lit(i).alias("i"), some_null.alias("some_null"), *values)
        by_type[families] = by_type[families].unionByName(rows) if families in by_type else rows
    out = None
    for rows in by_type.values():
        per_value = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
        part = per_value.groupBy("i").agg(((F.max("n") <= 1) & ~F.max("some_null")).alias("is_key"))
        out = part if out is None else out.unionByName(part)
    return out


# Values of a set that are looked at before it is tested on all of a large table.
FIRST_VALUES = 1 << 19


def key_tests(tables: Mapping[str, DataFrame], sets: Sequence[tuple[str, Sequence[str]]], rows: Sequence[int] | None = None) -> list[bool]:
    """Exact key test of each ``(table, columns)``, in one job; a table without rows has every key.

    With ``rows``, those of each set's table, a job before it looks at some ``FIRST_VALUES`` hashed
    values of each set of a large table.  All rows of a value are looked at or none, so one
    that occurs twice refutes the set for certain; whatever is left is tested on all rows."""
    left = list(range(len(sets)))
    large = [i for i in left if rows is not None and rows[i] > 4 * FIRST_VALUES]
    if large:
        below = {i: F.lit(-(1 << 63) + int((1 << 64) * FIRST_VALUES / rows[i])) for i in large}
        some = {str(i): tables[sets[i][0]].where(F.xxhash64(*[f"`{c}`" for c in sets[i][1]]) < below[i]) for i in large}
        refuted = {i for i, is_key in zip(large, key_tests(some, [(str(i), sets[i][1]) for i in large])) if not is_key}
        left = [i for i in left if i not in refuted]
    report = _key_report(tables, [sets[i] for i in left])
    found = {left[r["i"]]: r["is_key"] for r in report.collect()} if report is not None else {}
    return [i in left and found.get(i, True) for i in range(len(sets))]


def candidate_keys(tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Exact key test for each ``(table, columns)``.

    A column set is a key iff no row has a null in it and no value combination
    occurs twice.  ``(table_name, key_columns, is_key)``; ``key_columns`` is
    the comma-joined list.
    """
    sets = [(t, [cols] if isinstance(cols, str) else list(cols)) for t, cols in candidates]
    spark = _spark(tables)
    names = spark.createDataFrame([(i, t, ",".join(cols)) for i, (t, cols) in enumerate(sets)], "i int, table_name string, key_columns string")
    report = _key_report(tables, sets)
    if report is None:
        return names.select("table_name", "key_columns", F.lit(True).alias("is_key"))
    # a row per candidate on both sides
    return names.join(F.broadcast(report), "i", "left").select("table_name", "key_columns", F.coalesce("is_key", F.lit(True)).alias("is_key"))


_KEY_TYPES = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def key_like_columns(df: DataFrame) -> list[str]:
    """Columns whose type can be a key (no floating point, no nested types)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KEY_TYPES)]


def _lg_registers(rsd: float) -> int:
    """Registers (as a power of two) of a sketch with this relative standard error."""
    return max(4, min(21, math.ceil(2 * math.log2(1.04 / rsd))))


def _hll_report(df: DataFrame, table: str, sets: list[tuple[str, ...]], rsd: float) -> DataFrame:
    """One aggregate pass over ``df``: rows, and per column set a sketched number of
    distinct values and the number of rows with a NULL in it, as long-format rows.

    A sketch is one binary value (not a field per register), so a pass over many column
    sets stays a small aggregate; a set goes in as one 64-bit hash of its values."""
    hashes, aggs = [], [F.count(F.lit(1)).alias("__rows")]
    for i, cols in enumerate(sets):
        quoted = [f"`{c}`" for c in cols]
        whole = F.lit(True)
        for c in quoted:
            whole = whole & F.col(c).isNotNull()
        # hashed in a projection of its own, which is compiled; a sketch's own argument is not
        hashes.append(F.when(whole, F.xxhash64(*quoted)).alias(f"__h{i}"))
        aggs += [F.hll_sketch_agg(f"__h{i}", _lg_registers(rsd)).alias(f"__d{i}"), F.count(f"__h{i}").alias(f"__v{i}")]
    return df.select(*hashes).agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("t"), F.lit(i).alias("i"), F.col("__rows").alias("n"),
                 F.coalesce(F.hll_sketch_estimate(f"__d{i}"), F.lit(0)).alias("d"), (F.col("__rows") - F.col(f"__v{i}")).alias("z"))
        for i in range(len(sets))
    ])).alias("x")).select("x.*")


class SetStats(NamedTuple):
    rows: int
    distinct: int  # estimate
    nulls: int     # rows with a NULL in one of the columns


def sketch_sets(tables: Mapping[str, DataFrame], per_table: Mapping[str, Sequence[tuple[str, ...]]],
                rsd: float) -> dict[tuple[str, tuple[str, ...]], SetStats]:
    """Rows, distinct values (sketched) and NULLs of column sets: one job, one pass per table."""
    report = None
    for t, sets in per_table.items():
        if sets:
            part = _hll_report(tables[t], t, list(sets), rsd)
            report = part if report is None else report.unionByName(part)
    return {(r["t"], tuple(per_table[r["t"]][r["i"]])): SetStats(r["n"], r["d"], r["z"]) for r in (report.collect() if report is not None else [])}


def _keep(tables, per_table: dict[str, list[tuple[str, ...]]], rsd: float) -> dict[str, list[tuple[str, ...]]]:
    out: dict[str, list[tuple[str, ...]]] = {t: [] for t in per_table}
    slack = max(1.0 - SKETCH_ERRORS * rsd, 0.0)
    for (t, s), seen in sketch_sets(tables, per_table, rsd).items():
        if seen.nulls == 0 and seen.distinct >= seen.rows * slack:
            out[t].append(s)
    for t in out:
        out[t].sort(key=per_table[t].index)
    return out


# Relative standard errors below the row count at which a sketch rules a column set
# out: an estimate this far off does not happen.
SKETCH_ERRORS = 7


def shortlist_keys_many(tables: Mapping[str, DataFrame], names: Sequence[str], rsd: float = 0.03,
                        pairs: bool = True, max_width: int = 2) -> dict[str, list[tuple[str, ...]]]:
    """Column sets that *may* be keys, per table, from HyperLogLog passes run
    as one job for all tables (the driver gets one row per column set).

    Single columns first; sets of 2, 3, ... up to ``max_width`` columns only for
    tables where no smaller set qualifies.  The sketch only prunes: anything
    within ``SKETCH_ERRORS`` relative standard errors of the row count stays a
    candidate, and :func:`candidate_keys` decides exactly.
    """
    found = _keep(tables, {t: [(c,) for c in key_like_columns(tables[t])] for t in names}, rsd)
    for width in range(2, max_width + 1 if pairs else 2):
        need = {t: list(combinations(key_like_columns(tables[t]), width)) for t in names if not found[t]}
        if need:
            found.update(_keep(tables, need, rsd))
    return found


def shortlist_keys_of_width(tables: Mapping[str, DataFrame], names: Sequence[str], width: int,
                            rsd: float = 0.03) -> dict[str, list[tuple[str, ...]]]:
    """The sets of ``width`` columns of each table that may be keys."""
    return _keep(tables, {t: list(combinations(key_like_columns(tables[t]), width)) for t in names}, rsd)


def shortlist_keys(df: DataFrame, rsd: float = 0.03, pairs: bool = True) -> list[tuple[str, ...]]:
    """:func:`shortlist_keys_many` for one DataFrame."""
    return shortlist_keys_many({"t": df}, ["t"], rsd, pairs)["t"]


_STATS_ROWS = re.compile(r"(\d+)\s+rows")


def stats_row_counts(spark, names: Sequence[str], database: str | None = None, analyze: bool = False) -> DataFrame:
    """``(table_name, row_count)`` from catalog statistics, without scanning.

    The count comes from the ``Statistics`` entry of ``DESCRIBE TABLE
    EXTENDED``; a missing entry or *any* failure gives NULL for that table and
    never aborts the others.  ``analyze=True`` first runs ``ANALYZE TABLE …
    COMPUTE STATISTICS`` (that one does scan).
    """
    out = []
    for n in names:
        ident = f"`{database}`.`{n}`" if database else f"`{n}`"
        count = None
        try:
            if analyze:
                spark.sql(f"ANALYZE TABLE {ident} COMPUTE STATISTICS")
            for r in spark.sql(f"DESCRIBE TABLE EXTENDED {ident}").collect():
                if r["col_name"] == "Statistics":
                    m = _STATS_ROWS.search(r["data_type"] or "")
                    count = int(m.group(1)) if m else None
        except Exception:  # statistics are optional: report NULL, keep going
            count = None
        out.append((n, count))
    return spark.createDataFrame(out, "table_name string, row_count bigint")


def describe_sources(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None,
                     include_row_counts: bool = True, include_sample_values: bool = False,
                     detect_keys: bool = False, k: int = 5) -> DataFrame:
    """Source metadata, one row per column: ``table_name, ordinal, column_name,
    data_type, is_nullable, is_primary_key, row_count[, sample_values]``.

    Row counts (one job for all tables), samples (k smallest distinct values
    as strings, off by default) and key detection (single columns: HyperLogLog
    shortlist, exact confirm) are opt-in like the catalog reader they replace;
    with a flag off the column is NULL / FALSE.  Every join here is between
    metadata frames of at most one row per column, so they are broadcast.
    """
    names = sorted(names if names is not None else tables)
    spark = _spark(tables)
    out = catalog_columns(tables, names)
    if include_row_counts:
        out = out.join(F.broadcast(row_counts(tables, names)), "table_name", "left")
    else:
        out = out.withColumn("row_count", F.lit(None).cast("bigint"))
    if detect_keys:
        short = shortlist_keys_many(tables, names, pairs=False)
        cands = [(t, [c]) for t in names for (c,) in short[t]]
        if cands:
            keys = candidate_keys(tables, cands).where("is_key").select(
                "table_name", F.col("key_columns").alias("column_name"), F.lit(True).alias("is_primary_key"))
        else:
            keys = spark.createDataFrame([], "table_name string, column_name string, is_primary_key boolean")
        out = out.join(F.broadcast(keys), ["table_name", "column_name"], "left").withColumn(
            "is_primary_key", F.coalesce("is_primary_key", F.lit(False)))
    else:
        out = out.withColumn("is_primary_key", F.lit(False))
    cols = ["table_name", "ordinal", "column_name", "data_type", "is_nullable", "is_primary_key", "row_count"]
    if include_sample_values:
        parts = [sample_values(tables[t], tables[t].columns, k, table_name=t) for t in names]
        samples = parts[0]
        for p in parts[1:]:
            samples = samples.unionByName(p)
        per_col = samples.groupBy("table_name", "column_name").agg(
            F.array_sort(F.collect_list("sample_value")).alias("sample_values"))  # at most k each
        out = out.join(F.broadcast(per_col), ["table_name", "column_name"], "left")
        cols.append("sample_values")
    return out.select(*cols).orderBy("table_name", "ordinal")
