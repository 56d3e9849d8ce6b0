"""Incremental refresh: batch merge and Structured Streaming equal a full rebuild."""

import pytest
from pyspark.sql import functions as F

from starmart.errors import NonAdditiveMetricError
from starmart.operators.facts import build_fact, fact_rows
from starmart.plans import tpch_mart as M
from starmart.session import scratch_path
from starmart.sources.tables import load_tables
from starmart.spec import Fact, Metric
from starmart.streaming.incremental import current_version, merge_fact, read_current, start_fact_stream

from conftest import SF_SMALL


def _sorted(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_stream_equals_full_rebuild(spark):
    t = load_tables(spark, SF_SMALL)
    events = t["events"]
    src = scratch_path(spark, "events-src")
    # Three arrivals of files, split by time, all derived from the given table.
    cuts = ["2024-01-08", "2024-01-16"]
    ts = F.col("ts")
    parts = [ts < F.lit(cuts[0]).cast("timestamp_ntz"),
             (ts >= F.lit(cuts[0]).cast("timestamp_ntz")) & (ts < F.lit(cuts[1]).cast("timestamp_ntz")),
             ts >= F.lit(cuts[1]).cast("timestamp_ntz")]
    root = scratch_path(spark, "fact-events")
    ckpt = scratch_path(spark, "ckpt")
    for i, cond in enumerate(parts):
        events.where(cond).write.parquet(f"{src}/part={i}")
    q = start_fact_stream(spark, M.FACT_EVENTS, "events", f"{src}/*", events.schema, root, ckpt, spec=M.SALES_MART)
    q.awaitTermination(300)
    assert current_version(spark, root) == q.lastProgress["batchId"]
    got = read_current(spark, root)
    want = build_fact(M.FACT_EVENTS, t, M.SALES_MART)
    assert _sorted(got) == _sorted(want)


def test_merge_refuses_non_additive(spark):
    t = load_tables(spark, SF_SMALL)
    f = Fact("f", ("events",), (Metric("a", "avg", "value"),), ("user_id",))
    fact = build_fact(f, t)
    with pytest.raises(NonAdditiveMetricError):
        merge_fact(fact, fact, f, fact_rows(f, t))


def test_stream_restart_from_checkpoint(spark):
    """A restarted query resumes from its checkpoint: new files only, same result."""
    t = load_tables(spark, SF_SMALL)
    events = t["events"]
    src, root, ckpt = scratch_path(spark, "src"), scratch_path(spark, "fact"), scratch_path(spark, "ckpt")
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    events.where(F.col("ts") < cut).write.parquet(f"{src}/part=0")
    q = start_fact_stream(spark, M.FACT_EVENTS, "events", f"{src}/*", events.schema, root, ckpt, spec=M.SALES_MART)
    q.awaitTermination(300)
    first = current_version(spark, root)
    events.where(F.col("ts") >= cut).write.parquet(f"{src}/part=1")
    q = start_fact_stream(spark, M.FACT_EVENTS, "events", f"{src}/*", events.schema, root, ckpt, spec=M.SALES_MART)
    q.awaitTermination(300)
    assert current_version(spark, root) > first
    assert _sorted(read_current(spark, root)) == _sorted(build_fact(M.FACT_EVENTS, t, M.SALES_MART))


def test_partitioned_refresh_rewrites_only_touched_periods(spark):
    from starmart.queries import FACT_EVENTS_DAILY
    from starmart.sinks.publish import write_table
    from starmart.streaming.incremental import refresh_partitioned_fact
    t = load_tables(spark, SF_SMALL)
    ev = t["events"]
    cut = F.lit("2024-01-20 06:00:00").cast("timestamp_ntz")
    root = scratch_path(spark, "part-refresh")
    write_table(build_fact(FACT_EVENTS_DAILY, {"events": ev.where(F.col("ts") < cut)}), f"{root}/fact",
                partition_by=["period"])
    before = {r.period: r for r in spark.read.parquet(f"{root}/fact").where("period < '2024-01-20'").collect()}
    touched = refresh_partitioned_fact(FACT_EVENTS_DAILY, f"{root}/fact",
                                       {"events": ev.where(F.col("ts") >= cut)}, f"{root}/staging")
    assert min(touched).isoformat() == "2024-01-20"
    got = spark.read.parquet(f"{root}/fact")
    assert _sorted(got) == _sorted(build_fact(FACT_EVENTS_DAILY, t))
    # a rerun with the same staging folder (as after a crash) does not merge twice
    refresh_partitioned_fact(FACT_EVENTS_DAILY, f"{root}/fact", {"events": ev.where(F.col("ts") >= cut)},
                             f"{root}/staging")
    got = spark.read.parquet(f"{root}/fact")
    assert _sorted(got) == _sorted(build_fact(FACT_EVENTS_DAILY, t))
    # untouched periods keep their rows
    after = {r.period: r for r in got.where("period < '2024-01-20'").collect()}
    assert after == before


def test_partitioned_stream_equals_rebuild_and_replay_is_exact(spark):
    from starmart.queries import FACT_EVENTS_DAILY
    from starmart.sinks.publish import write_table
    from starmart.streaming.incremental import start_partitioned_fact_stream
    t = load_tables(spark, SF_SMALL)
    ev = t["events"]
    src, root, ckpt = scratch_path(spark, "psrc"), scratch_path(spark, "pfact"), scratch_path(spark, "pckpt")
    c1, c2 = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 08:00:00", "2024-01-22 20:00:00"))
    write_table(build_fact(FACT_EVENTS_DAILY, {"events": ev.where(F.col("ts") < c1)}), f"{root}/fact",
                partition_by=["period"])
    ev.where((F.col("ts") >= c1) & (F.col("ts") < c2)).write.parquet(f"{src}/part=0")
    ev.where(F.col("ts") >= c2).write.parquet(f"{src}/part=1")
    q = start_partitioned_fact_stream(spark, FACT_EVENTS_DAILY, "events", f"{src}/*", ev.schema, f"{root}/fact",
                                      f"{root}/staging", ckpt)
    q.awaitTermination(300)
    want = _sorted(build_fact(FACT_EVENTS_DAILY, t))
    assert _sorted(spark.read.parquet(f"{root}/fact")) == want
    # a replay of the last batch (as after a crash before its offsets were committed) changes nothing
    from starmart.streaming.incremental import _query_id, apply_partitioned_batch
    last = q.lastProgress["batchId"]
    replayed = spark.read.parquet(f"{src}/part=1")
    apply_partitioned_batch(replayed, last, FACT_EVENTS_DAILY, "events", f"{root}/fact", f"{root}/staging",
                            query_id=_query_id(spark, ckpt))
    assert _sorted(spark.read.parquet(f"{root}/fact")) == want
