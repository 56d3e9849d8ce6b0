"""Date dimension: one row per day between the first and last date of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_dimension(df: DataFrame, column: str) -> DataFrame:
    """``(date_key, year, quarter, month)`` for every day from min to max of ``column``.

    The row count is the calendar span of the data (days), not its size.
    """
    bounds = df.agg(F.min(F.col(column).cast("date")).alias("lo"), F.max(F.col(column).cast("date")).alias("hi"))
    days = bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    return days.select(
        "date_key",
        F.year("date_key").alias("year"),
        F.quarter("date_key").alias("quarter"),
        F.month("date_key").alias("month"),
    )
