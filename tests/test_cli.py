"""The command line runs a JSON spec and intent end to end."""

import json
import os

from starmart.__main__ import main
from starmart.session import scratch_path

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SPEC = os.path.join(ROOT, "examples", "sales_mart.json")
INTENT = os.path.join(ROOT, "examples", "revenue_by_region.json")


def test_cli_ask_writes_result(spark):
    out = scratch_path(spark, "cli") + "/answer"
    assert main(["ask", "--source", SF_SMALL, "--spec", SPEC, "--intent", INTENT, "--fact", "fact_orders",
                 "--write", out]) == 0
    df = spark.read.parquet(out)
    assert sorted(df.columns) == ["order_count", "period", "r_name", "total_revenue"]
    assert df.count() > 0


def test_cli_check_and_publish(spark, capsys):
    assert main(["check", "--source", SF_SMALL, "--spec", SPEC]) == 0
    root = scratch_path(spark, "cli-mart")
    assert main(["publish", "--source", SF_SMALL, "--spec", SPEC, "--out", root]) == 0
    printed = capsys.readouterr().out.strip().splitlines()[-1]
    assert set(json.loads(printed)["tables"]) >= {"dim_customer", "fact_orders"}


def test_spec_json_roundtrip_matches_module_spec():
    from starmart.plans.tpch_mart import SALES_MART
    from starmart.spec import MartSpec
    assert MartSpec.from_json(open(SPEC).read()) == SALES_MART


def test_cli_schema(capsys):
    assert main(["schema", "--source", SF_SMALL, "--spec", SPEC]) == 0
    out = capsys.readouterr().out
    assert "c_custkey bigint PRIMARY KEY NOT NULL" in out
    assert "o_custkey bigint NOT NULL REFERENCES dim_customer.c_custkey, dim_customer_geo.c_custkey" in out


def test_spec_source_tables():
    from starmart.plans.tpch_mart import SALES_MART
    assert SALES_MART.source_tables() == ["customer", "events", "lineitem", "nation", "orders", "part",
                                          "region", "supplier"]


def test_cli_profile_and_discover(capsys):
    assert main(["profile", "--source", SF_SMALL, "--tables", "region,nation"]) == 0
    out = capsys.readouterr().out
    assert "r_regionkey" in out and "n_nationkey" in out
    assert main(["discover", "--source", SF_SMALL, "--tables", "region,nation,customer,orders"]) == 0
    out = capsys.readouterr().out
    assert "o_custkey" in out and '"mart_name": "orders_mart"' in out
