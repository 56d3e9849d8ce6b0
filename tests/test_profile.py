"""Profiles (P6, P7) against brute force on the test tables, across many partitions."""

import pytest
from pyspark.sql import functions as F

from starmart.operators import profile
from starmart.sources.tables import load_tables

from conftest import SF_SMALL

COLS = ["l_returnflag", "l_shipdate", "l_quantity", "l_partkey", "l_linestatus"]


@pytest.fixture(scope="module")
def lineitem(spark):
    li = load_tables(spark, SF_SMALL)["lineitem"]
    # a third of the rows share one part key; spread over many partitions
    hot = li.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_partkey")))
    return hot.repartition(13)


def test_sample_values_match_brute_force(spark, lineitem):
    got = {}
    for r in profile.sample_values(lineitem, COLS, k=5).collect():
        got.setdefault(r.column_name, []).append(r.sample_value)
    pdf = lineitem.select(*[F.col(c).cast("string").alias(c) for c in COLS]).toPandas()
    for c in COLS:
        vals = sorted(set(v for v in pdf[c] if v is not None), key=lambda s: s.encode("utf-8"))[:5]
        assert sorted(got[c]) == sorted(vals), c


def test_profile_exact_and_approx(spark, lineitem):
    exact = {r.column_name: r for r in profile.profile_columns(lineitem, COLS, "lineitem").collect()}
    pdf = lineitem.select(*COLS).toPandas()
    for c in COLS:
        assert exact[c].row_count == len(pdf)
        assert exact[c].null_count == int(pdf[c].isna().sum())
        assert exact[c].distinct_count == pdf[c].nunique()
    approx = {r.column_name: r.distinct_count
              for r in profile.profile_columns(lineitem, COLS, exact=False, rsd=0.02).collect()}
    for c in COLS:
        assert abs(approx[c] - exact[c].distinct_count) <= max(2, 0.1 * exact[c].distinct_count)


def test_describe_sources_with_array_column(spark):
    t = load_tables(spark, SF_SMALL)
    rows = {r.column_name: r for r in profile.describe_sources(
        t, ["embeddings"], include_sample_values=True, detect_keys=True).collect()}
    assert rows["embedding"].data_type == "array<float>"
    assert rows["embedding"].is_primary_key is False  # nested types are never keys
    assert 1 <= len(rows["embedding"].sample_values) <= 5
    assert rows["vec_id"].is_primary_key
