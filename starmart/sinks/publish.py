"""Publishing a mart as Parquet tables (full refresh, checks before publish).

Layout under ``root`` (a shared folder, e.g. under ``spark.checkpoint.dir``)::

    root/<run_id>/<table>/        one folder per table of one run (never reused)
    root/<run_id>/_checks/        the run's check report (JSON, one row per check)
    root/_published/              append-only JSON log: one row per published run

A run writes every dimension, then every fact, reads them back (the written
tables cut the lineage: checks do not recompute the build), runs the check
report on the written tables, and only then appends the run to the log; the
current mart is the latest logged run.  A failing check leaves the previous run
current and raises.  Nothing is renamed, overwritten or deleted, so a lost
executor can only fail a write that is simply retried.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.errors import CheckFailedError
from starmart.operators.checks import check_report, failures
from starmart.operators.dims import build_dimension
from starmart.operators.facts import build_fact
from starmart.spec import MartSpec, validate_spec

PUBLISHED_LOG = "_published"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write Parquet.  A partitioned write is first rebalanced on the partition
    columns (few files per partition value), and AQE splits a partition value
    that is too large for one task instead of sending it all to one writer."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class PublishedMart:
    root: str
    run_id: str
    tables: tuple[str, ...]

    def path(self, table: str) -> str:
        return f"{self.root}/{self.run_id}/{table}"

    def read(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {t: spark.read.parquet(self.path(t)) for t in self.tables}


def publish_mart(spec: MartSpec, tables: Mapping[str, DataFrame], root: str, run_id: str | None = None,
                 check: bool = True, partition_facts_by_period: bool = True,
                 accepted: Mapping[str, Mapping[str, Sequence]] | None = None) -> PublishedMart:
    """Build, write, check and publish every table of ``spec`` (dimensions first)."""
    validate_spec(spec, tables)
    spark = next(iter(tables.values())).sparkSession
    run_id = run_id or uuid.uuid4().hex[:12]
    root = root.rstrip("/")
    written: dict[str, DataFrame] = {}
    for d in spec.dimensions:
        path = f"{root}/{run_id}/{d.name}"
        write_table(build_dimension(d, tables), path)
        written[d.name] = spark.read.parquet(path)
    for f in spec.facts:
        path = f"{root}/{run_id}/{f.name}"
        parts = ["period"] if (partition_facts_by_period and f.time_grain is not None) else []
        write_table(build_fact(f, tables, spec), path, parts)
        written[f.name] = spark.read.parquet(path)
    mart = PublishedMart(root, run_id, tuple(written))
    if check:
        report = check_report(spec, tables, built=written, accepted=accepted)
        # The evidence of every run, passed or not (one row per check).
        report.coalesce(1).write.mode("overwrite").json(f"{root}/{run_id}/_checks")
        bad = failures(spark.read.schema(report.schema).json(f"{root}/{run_id}/_checks"))
        if bad:
            raise CheckFailedError(
                f"mart '{spec.mart_name}' run {run_id}: {len(bad)} check(s) failed; not published: "
                + "; ".join(f"{b['table_name']}.{b['column_name']} {b['check_name']} = {b['n_violations']}"
                            for b in bad),
                bad,
            )
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    entry = spark.createDataFrame([(stamp, run_id, ",".join(mart.tables))],
                                  "published_at string, run_id string, tables string")
    entry.coalesce(1).write.mode("append").json(f"{root}/{PUBLISHED_LOG}")
    return mart


def current_mart(spark: SparkSession, root: str) -> PublishedMart:
    """The latest published run under ``root``."""
    log = spark.read.schema("published_at string, run_id string, tables string").json(
        f"{root.rstrip('/')}/{PUBLISHED_LOG}")
    row = log.orderBy(F.col("published_at").desc(), F.col("run_id").desc()).first()
    if row is None:
        raise FileNotFoundError(f"no mart has been published under {root}")
    return PublishedMart(root.rstrip("/"), row["run_id"], tuple(row["tables"].split(",")))
