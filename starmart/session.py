"""Session helpers: a local session for tests/bench and the shared work folder.

The library never assumes a machine-local folder on a cluster: intermediate
tables and lineage cuts go under the folder the cluster names in
``spark.checkpoint.dir``.  Only a ``local[...]`` session without that setting
(tests, bench) gets a fresh temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "starmart") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("STARMART_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Rows that a task groups or sorts at most, about; some 100 to 300 MB of memory.
ROWS_PER_TASK = 1_000_000
# Up to so many partitions (Spark's default for it) a task that writes to an exchange puts each
# row into its partition's file; beyond, it first holds what it read, a whole row group.
_UNHELD_PARTITIONS = 200
# Bytes up to which AQE may merge the partitions of an exchange of many rows; some ROWS_PER_TASK rows of a few columns.
_MERGED_BYTES = 16 * 1024 * 1024
_PARTITIONS, _MERGED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions that give a task at most some ``ROWS_PER_TASK`` of ``rows`` rows, or three
    times as many where the exchange's writers would else hold their rows; never fewer than
    the session's."""
    tasks = -(-rows // ROWS_PER_TASK)
    if tasks > _UNHELD_PARTITIONS:
        tasks = max(_UNHELD_PARTITIONS, -(-tasks // 3))
    return max(int(spark.conf.get(_PARTITIONS)), tasks)


def dealt(df: DataFrame, rows: int, *by: str | Column) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``by`` into small tasks, unless a task can take them all.

    What is grouped by ``by`` next is grouped where it is: no task first groups all that it
    read, however large the files are."""
    return df if rows <= ROWS_PER_TASK else df.repartition(tasks_for(df.sparkSession, rows), *by)


@contextmanager
def exchanges_for(spark: SparkSession, rows: int) -> Iterator[int]:
    """Jobs run inside have enough partitions for exchanges of ``rows`` rows; yields how
    many tasks the rows fill."""
    filled = -(-rows // ROWS_PER_TASK)
    if filled <= 1:
        yield filled
        return
    before = {k: spark.conf.get(k, None) for k in (_PARTITIONS, _MERGED)}
    try:
        spark.conf.set(_PARTITIONS, tasks_for(spark, rows))
        spark.conf.set(_MERGED, f"{_MERGED_BYTES}b")
        yield filled
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Read from the session (``spark.checkpoint.dir``).  Set our own only when it
    is unset and the session is local, as in tests.
    """
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # some sessions refuse reading static settings
        configured = None
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no SparkContext
        sc = None
    if configured:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc is None:
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is needed for intermediate tables.")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        # setCheckpointDir appends a per-application folder; use its parent.
        return current.rstrip("/").rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared folder "
            "(e.g. an object-store or HDFS path) for lineage cuts and mart tables."
        )
    path = tempfile.mkdtemp(prefix="starmart-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_dir(spark)}/starmart/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs read it, so a lost
    executor costs one task and not the whole lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
