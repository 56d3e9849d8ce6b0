"""Command line: run a mart spec against Parquet sources with the current Spark session.

    python -m starmart profile  --source DIR [--tables a,b]
    python -m starmart discover --source DIR [--tables a,b]
    python -m starmart schema   --source DIR --spec SPEC.json
    python -m starmart check    --source DIR --spec SPEC.json
    python -m starmart publish  --source DIR --spec SPEC.json --out ROOT
    python -m starmart ask      --source DIR --spec SPEC.json --intent INTENT.json [--fact NAME]

Reports are printed (bounded: one row per column, check or proposal); query
results are written with ``--write PATH`` or shown (``--show N`` rows).
Submit it with spark-submit on a cluster; locally it starts ``local[*]``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    """The active session, else a new one.  Without a master from spark-submit
    it runs ``local[*]`` with the web UI off."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from pyspark import SparkConf
    builder = SparkSession.builder.appName("starmart")
    if not SparkConf().contains("spark.master"):
        builder = builder.master("local[*]").config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def _show(report) -> None:
    """A whole report, one line a row (reports have a row per column or check, not per data row)."""
    print("\t".join(report.columns))
    for row in report.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv=None) -> int:
    from starmart.operators import checks, discover, profile, star
    from starmart.sinks.publish import publish_mart
    from starmart.sources.tables import load_tables
    from starmart.spec import Intent, MartSpec

    p = argparse.ArgumentParser(prog="starmart")
    p.add_argument("command", choices=["profile", "discover", "schema", "check", "publish", "ask"])
    p.add_argument("--source", required=True, help="folder of <table>.parquet")
    p.add_argument("--tables", help="comma-separated table names (default: all)")
    p.add_argument("--spec", help="MartSpec JSON file")
    p.add_argument("--intent", help="Intent JSON file")
    p.add_argument("--fact", help="fact to answer from")
    p.add_argument("--out", help="publish root (shared storage)")
    p.add_argument("--write", help="write the query result as Parquet here")
    p.add_argument("--show", type=int, default=20)
    a = p.parse_args(argv)

    spark = _session()
    spec = MartSpec.from_json(open(a.spec).read()) if a.spec else None
    tables = load_tables(spark, a.source, spec.source_tables() if spec else None)
    names = a.tables.split(",") if a.tables else list(tables)

    if a.command == "profile":
        for n in names:
            _show(profile.profile_columns(tables[n], table_name=n, exact=False))
        return 0
    if a.command == "discover":
        _show(discover.star_candidates(tables, names=names).where("rank = 1"))
        for s in discover.propose_marts(tables, names):
            print(s.to_json())
        return 0
    if spec is None:
        p.error("--spec is required for " + a.command)
    if a.command == "schema":
        from starmart.plans.schema import describe, target_schemas
        print(describe(target_schemas(spec, tables)))
        return 0
    if a.command == "check":
        rep = checks.check_report(spec, tables)
        _show(rep)
        return 0 if not checks.failures(rep) else 1
    if a.command == "publish":
        if not a.out:
            p.error("--out is required for publish")
        mart = publish_mart(spec, tables, a.out)
        print(json.dumps({"run_id": mart.run_id, "tables": list(mart.tables)}))
        return 0
    intent = Intent(**json.load(open(a.intent)))
    df = star.answer(intent, spec, tables, fact_name=a.fact)
    if a.write:
        df.write.mode("errorifexists").parquet(a.write)
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
