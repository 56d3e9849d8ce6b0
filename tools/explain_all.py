"""Summarise the final (post-AQE) physical plan of every registered query.

    python tools/explain_all.py [sf_dir] > PLANS.md

Per query: shuffle exchanges, broadcast exchanges, join operators, aggregate
operators, and for each Parquet scan its pushed filters and read schema.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    scans = []
    for m in re.finditer(r"FileScan parquet (\S*)\[[^\]]*\][^\n]*", final):
        line = m.group(0)
        loc = re.search(r"Location: [^\[]*\[[^\]]*/([\w.=-]+?)(?:\.parquet)?\]", line)
        pf = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
        name = m.group(1) or (loc.group(1) if loc else "?")
        scans.append((name.split(".")[-1], pf.group(1) if pf else "", rs.group(1) if rs else ""))
    return {
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", final)),
        "broadcasts": final.count("BroadcastExchange"),
        "bhj": final.count("BroadcastHashJoin"),
        "smj": final.count("SortMergeJoin"),
        "hash_agg": final.count("HashAggregate"),
        "sort_agg": final.count("SortAggregate"),
        "window_limit": final.count("WindowGroupLimit"),
        "python": final.count("MapInPandas") + final.count("PythonMapInArrow"),
        "bucketed": final.count("Bucketed: true"),
        "scans": scans,
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from starmart.queries import registry
    from starmart.session import local_session
    spark = local_session(8, shuffle_partitions=16)
    print("# PLANS\n")
    print(f"Final physical plans (after AQE) of every registered query at `{sf_dir}`, "
          f"`local[8]`, 16 shuffle partitions; produced by `tools/explain_all.py`.\n")
    print("Columns: shuffle exchanges · broadcast exchanges · broadcast-hash / sort-merge joins · "
          "hash / sort aggregates · partial window limits · Python (Arrow) operators · bucketed scans.\n")
    print("| query | shuffles | broadcasts | BHJ | SMJ | hash agg | sort agg | window limit | python | bucketed |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    details = []
    for name, fn in registry().items():
        df = fn(spark, sf_dir)
        df.collect()
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['bhj']} | {s['smj']} | {s['hash_agg']} | "
              f"{s['sort_agg']} | {s['window_limit']} | {s['python']} | {s['bucketed']} |")
        details.append((name, s["scans"]))
    print("\n## Scans (pushed filters, read schema)\n")
    for name, scans in details:
        if not scans:
            continue
        print(f"* **{name}**")
        for table, pf, rs in scans:
            pf = f"pushed `{pf}`" if pf else "no filter"
            print(f"  * `{table}`: {pf}; reads `{rs}`")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
