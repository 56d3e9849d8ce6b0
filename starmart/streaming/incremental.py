"""Incremental fact refresh: batch merge and a Structured Streaming driver.

A refresh aggregates only the new source rows with the fact's own definition,
unions the result with the current fact and re-aggregates additively (sum and
count add up, min/max take the extreme).  Sums are merged in the exact type of
their expression (e.g. DECIMAL(38,2) for a money sum) and conformed to DOUBLE
only at the end, so the merged fact equals a full rebuild.  Averages and
approximate distinct counts merge from the state columns that
``build_fact(states=True)`` stores beside them, exact distinct counts of a column
from the sets that :func:`write_fact` stores beside the fact; without these they raise.

Every refresh writes a *new* version folder (never the folder being read); the
streaming variant names versions by micro-batch id, so a replayed batch
rewrites the same version from the same immutable inputs (idempotent), and
appends the version to a commit log only after its data is written; readers
take the latest logged version (``read_current``).
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone
from typing import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.errors import CheckFailedError, SpecError
from starmart.functions.metrics import merge_published
from starmart.operators import distinct
from starmart.operators.checks import failures, refresh_report
from starmart.operators.facts import build_fact, fact_keys, fact_rows
from starmart.operators.grains import drill_across, home_of
from starmart.session import written
from starmart.sinks.publish import write_table
from starmart.spec import Fact, MartSpec, Metric


def merge_fact(current: DataFrame, delta: DataFrame, fact: Fact, rows: DataFrame) -> DataFrame:
    """``current`` and ``delta`` are facts of ``fact`` (same columns); ``rows`` is
    any row-level input of the fact (used for types only, no job)."""
    keys = fact_keys(fact)
    merges = [c for m in fact.metrics for c in merge_published(m, rows, delta.columns)]
    both = current.select(*delta.columns).unionByName(delta)
    return both.groupBy(*keys).agg(*merges) if keys else both.agg(*merges)


def _delta(fact: Fact, tables: Mapping[str, DataFrame], spec: MartSpec | None, current: DataFrame) -> DataFrame:
    """The fact of the new rows, with state columns if the current fact has them.

    New rows are those of the primary table; a metric of another table would be
    counted again from all of that table's rows, so it is refused."""
    away = [m.name for m in fact.metrics if home_of(m, fact, tables) != fact.primary_table]
    if away:
        raise SpecError(f"Fact '{fact.name}' cannot be refreshed from new rows of '{fact.primary_table}': metrics {away} are of joined tables. "
                        f"Keep them in a fact of their own.")
    plain = set(fact_keys(fact)) | {m.name for m in fact.metrics}
    return build_fact(fact, tables, spec, states=not set(current.columns) <= plain)


def sets_path(fact_path: str, metric: Metric, ids: bool = False) -> str:
    """Where the sets behind an exact distinct count (or the ids of its values) lie, beside the fact."""
    return f"{fact_path.rstrip('/')}__{metric.name}__{'ids' if ids else 'sets'}"


def write_fact(fact: Fact, tables: Mapping[str, DataFrame], path: str, spec: MartSpec | None = None, mode: str = "error") -> DataFrame:
    """A first version that refreshes can merge into: the fact with its state columns at
    ``path``, and the sets of its exact distinct counts beside it."""
    spark = next(iter(tables.values())).sparkSession
    for m in distinct.set_metrics(fact):
        sets, ids = distinct.metric_sets(fact, m, tables, spec)
        write_table(sets, sets_path(path, m), mode=mode)
        if ids is not None:
            write_table(ids, sets_path(path, m, ids=True), mode=mode)
    write_table(build_fact(fact, tables, spec, states=True), path, mode=mode)
    return spark.read.parquet(path)


def refresh_fact(fact: Fact, current_path: str, delta_tables: Mapping[str, DataFrame], new_path: str,
                 spec: MartSpec | None = None, mode: str = "error", dims: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Merge the fact of ``delta_tables`` into the fact at ``current_path`` and
    write the result to ``new_path`` (a new folder); returns the written table.

    With ``dims`` (the published dimensions by name, and ``spec``) the new rows are
    checked first: a refresh that would break a rule of the mart raises
    ``CheckFailedError`` and writes nothing.

    Exact distinct counts merge through the sets that :func:`write_fact` or an earlier
    refresh left beside the fact: the new rows' sets are joined to them, written beside
    the new version, and counted."""
    spark = next(iter(delta_tables.values())).sparkSession
    current = spark.read.parquet(current_path)
    counted = [m for m in distinct.set_metrics(fact) if _exists(spark, sets_path(current_path, m))]
    plain = replace(fact, metrics=tuple(m for m in fact.metrics if m not in counted))
    keys = fact_keys(fact)
    delta = _delta(plain, delta_tables, spec, current.drop(*[m.name for m in counted]))
    if dims is not None:
        delta = written(delta, "delta")
        check_refresh(plain, spec, delta, current, dims)
    results = [merge_fact(current, delta, plain, fact_rows(fact, delta_tables, split_hot=False))]
    for m in counted:
        old_ids = sets_path(current_path, m, ids=True)
        known = spark.read.parquet(old_ids) if _exists(spark, old_ids) else None
        sets, ids = distinct.metric_sets(fact, m, delta_tables, spec, known)
        both = spark.read.parquet(sets_path(current_path, m)).unionByName(sets)
        write_table(distinct.merge_sets(both, keys), sets_path(new_path, m), mode=mode)
        if ids is not None:
            write_table(ids, sets_path(new_path, m, ids=True), mode=mode)
        results.append(distinct.count_sets(spark.read.parquet(sets_path(new_path, m)), keys, m.name))
    merged = results[0] if len(results) == 1 else drill_across(results, keys, fact.metrics)
    write_table(merged, new_path, mode=mode)
    return spark.read.parquet(new_path)


def check_refresh(fact: Fact, spec: MartSpec, delta: DataFrame, current: DataFrame, dims: Mapping[str, DataFrame]) -> None:
    bad = failures(refresh_report(fact, spec, delta, current, dims))
    if bad:
        raise CheckFailedError(f"fact '{fact.name}': {len(bad)} check(s) fail on the new rows; the current version stays.", bad)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


VERSION_LOG = "_versions"


def _marker_done(spark: SparkSession, path: str) -> bool:
    """Whether the stage was completed.  Only a missing marker means no: any
    other read error is raised, since a complete stage taken for a missing one
    would merge the delta a second time."""
    try:
        return spark.read.schema("done boolean").json(path).count() > 0
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _staged(spark: SparkSession, stage: str, schema: T.StructType) -> DataFrame:
    """The staged rows; the schema is given because an empty stage has no file."""
    return spark.read.schema(schema).parquet(f"{stage}/data")


def _overwrite_periods(spark: SparkSession, stage: str, fact_path: str, schema: T.StructType) -> None:
    (_staged(spark, stage, schema).select(*schema.fieldNames()).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("period").format("parquet").save(fact_path))


def _in_periods(df: DataFrame, periods: list) -> DataFrame:
    """Rows of the given periods, NULL being one of them.  A filter on values of
    the partition column: only those partitions are read."""
    dates = [p for p in periods if p is not None]
    wanted = F.col("period").isin(dates) if dates else F.lit(False)
    return df.where(wanted | F.col("period").isNull() if None in periods else wanted)


def _stage_and_overwrite(spark: SparkSession, fact: Fact, fact_path: str, tables: Mapping[str, DataFrame],
                         stage: str, spec: MartSpec | None, dims: Mapping[str, DataFrame] | None = None) -> None:
    """Merge ``tables``' rows into the affected periods of the fact, staged in
    ``stage`` with a completion marker, then overwrite those periods.  When the
    stage is already complete (a rerun after a crash) only the overwrite is
    repeated: it is idempotent, and the delta is never merged twice."""
    marker = f"{stage}/_stage_complete"
    current = spark.read.parquet(fact_path)
    if not _marker_done(spark, marker):
        delta = written(_delta(fact, tables, spec, current), "delta")
        if dims is not None:
            check_refresh(fact, spec, delta, current, dims)
        periods = [r["period"] for r in delta.select("period").distinct().collect()]  # one value per touched period
        merged = merge_fact(_in_periods(current, periods), delta, fact, fact_rows(fact, tables, split_hot=False))
        write_table(merged, f"{stage}/data", partition_by=["period"], mode="overwrite")
        spark.createDataFrame([(True,)], "done boolean").coalesce(1).write.mode("overwrite").json(marker)
    _overwrite_periods(spark, stage, fact_path, current.schema)


def refresh_partitioned_fact(fact: Fact, fact_path: str, delta_tables: Mapping[str, DataFrame], staging_path: str,
                             spec: MartSpec | None = None, dims: Mapping[str, DataFrame] | None = None) -> list:
    """Merge new rows into a fact published partitioned by ``period``,
    rewriting only the periods the new rows touch.

    1. the delta is aggregated with the fact's own definition;
    2. its periods (one value per period, NULL included: a bounded list) select
       the affected partitions of the current fact - a filter on the partition
       column, so only those are read;
    3. the exact merge is written to ``staging_path`` (a new folder, marked
       complete once written);
    4. the staged partitions replace the affected ones with a dynamic partition
       overwrite, which reads the staging folder, never the folder it writes.
    Rerunning with the same ``staging_path`` after a crash repeats only step 4.
    A delta without rows changes nothing, nor does one that fails the checks (``dims``,
    as in :func:`refresh_fact`).  Returns the rewritten periods, NULL
    (rows without a time) last.
    """
    if fact.time_grain is None:
        raise ValueError(f"fact '{fact.name}' has no time grain to partition by; use refresh_fact")
    spark = next(iter(delta_tables.values())).sparkSession
    _stage_and_overwrite(spark, fact, fact_path, delta_tables, staging_path.rstrip("/"), spec, dims)
    staged = _staged(spark, staging_path.rstrip("/"), spark.read.parquet(fact_path).schema)
    found = [r["period"] for r in staged.select("period").distinct().collect()]
    return sorted((p for p in found if p is not None)) + [None] * (None in found)


def apply_partitioned_batch(batch: DataFrame, epoch_id: int, fact: Fact, source_table: str, fact_path: str,
                            staging_root: str, other_tables: Mapping[str, DataFrame] | None = None,
                            spec: MartSpec | None = None, query_id: str = "batches") -> None:
    """One micro-batch of :func:`start_partitioned_fact_stream` (idempotent per
    ``query_id`` and ``epoch_id``)."""
    tables = {**dict(other_tables or {}), source_table: batch}
    stage = f"{staging_root.rstrip('/')}/{query_id}/{epoch_id}"
    _stage_and_overwrite(batch.sparkSession, fact, fact_path, tables, stage, spec)


def _query_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The streaming query's id, kept in its checkpoint: a reset checkpoint counts
    its batches from 0 again under another id and meets no stage of the old one."""
    row = spark.read.schema("id string").json(f"{checkpoint_location.rstrip('/')}/metadata").first()
    return row["id"]


def start_partitioned_fact_stream(
    spark: SparkSession,
    fact: Fact,
    source_table: str,
    source_path: str,
    source_schema: T.StructType,
    fact_path: str,
    staging_root: str,
    checkpoint_location: str,
    other_tables: Mapping[str, DataFrame] | None = None,
    spec: MartSpec | None = None,
    available_now: bool = True,
):
    """Keep a period-partitioned fact up to date, rewriting only touched periods.

    Micro-batch ``e``: (1) unless ``staging_root/<query id>/e`` is complete, merge the
    batch into the affected periods of the current fact and stage the result
    there, then write a completion marker; (2) overwrite those periods from the
    stage (dynamic partition overwrite).  A replayed batch finds its complete
    stage - computed from the state before the batch - and only repeats step 2,
    which is idempotent, so no row is counted twice.  The fact folder must exist
    (publish the initial fact partitioned by ``period``).
    """
    if fact.time_grain is None:
        raise ValueError(f"fact '{fact.name}' has no time grain to partition by; use start_fact_stream")
    others = dict(other_tables or {})

    def merge_batch(batch: DataFrame, epoch_id: int) -> None:
        query_id = _query_id(batch.sparkSession, checkpoint_location)
        apply_partitioned_batch(batch, epoch_id, fact, source_table, fact_path, staging_root, others, spec, query_id)

    stream = spark.readStream.schema(source_schema).parquet(source_path)
    writer = stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version}"


def log_version(spark: SparkSession, root: str, version: int) -> None:
    """Append ``version`` to the root's commit log (after its data is written)."""
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    spark.createDataFrame([(version, stamp)], "version bigint, written_at string").coalesce(1) \
        .write.mode("append").json(f"{root.rstrip('/')}/{VERSION_LOG}")


def current_version(spark: SparkSession, root: str) -> int:
    """Latest version whose write completed (a replayed batch may log twice)."""
    log = spark.read.schema("version bigint, written_at string").json(f"{root.rstrip('/')}/{VERSION_LOG}")
    row = log.agg(F.max("version").alias("v")).first()
    if row is None or row["v"] is None:
        raise FileNotFoundError(f"no version has been written under {root}")
    return int(row["v"])


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(version_path(root, current_version(spark, root)))


def start_fact_stream(
    spark: SparkSession,
    fact: Fact,
    source_table: str,
    source_path: str,
    source_schema: T.StructType,
    mart_root: str,
    checkpoint_location: str,
    base_path: str | None = None,
    other_tables: Mapping[str, DataFrame] | None = None,
    spec: MartSpec | None = None,
    available_now: bool = True,
    on_version: Callable[[int, str], None] | None = None,
):
    """Keep a fact up to date from new Parquet files under ``source_path``.

    Micro-batch ``e`` merges its rows into version ``e - 1`` (``base_path`` or
    nothing for the first) and writes version ``e``.  Returns the running
    ``StreamingQuery``; with ``available_now`` it stops after the files present.
    """
    others = dict(other_tables or {})

    def merge_batch(batch: DataFrame, epoch_id: int) -> None:
        tables = {**others, source_table: batch}
        out = version_path(mart_root, epoch_id)
        prev = version_path(mart_root, epoch_id - 1) if epoch_id > 0 else base_path
        if prev is None:
            write_fact(fact, tables, out, spec, mode="overwrite")
        else:
            refresh_fact(fact, prev, tables, out, spec, mode="overwrite")
        log_version(batch.sparkSession, mart_root, epoch_id)
        if on_version is not None:
            on_version(epoch_id, out)

    stream = spark.readStream.schema(source_schema).parquet(source_path)
    writer = stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
