import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from starmart.session import local_session
    s = local_session("*", shuffle_partitions=8, app="starmart-tests")
    yield s


@pytest.fixture(scope="session")
def fixture1(spark):
    """orders / customers profile fixture (FIXTURES.md 1)."""
    import datetime as dt
    orders = spark.createDataFrame(
        [(1, 71, dt.date(2024, 1, 1), 41.5), (2, 72, dt.date(2024, 1, 2), 63.25), (3, 71, dt.date(2024, 1, 3), 18.0)],
        "order_id int, customer_id int, order_date date, total_amount double")
    customers = spark.createDataFrame([(71, "Ines", "Coast"), (72, "Teo", "Hills")],
                                      "customer_id int, name string, region string")
    return {"orders": orders, "customers": customers}
