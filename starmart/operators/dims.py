"""Dimension builds: key first, then attributes, from one source table.

No filter, no grouping.  ``dedupe=True`` collapses identical rows (a dimension
taken from a non-unique source, e.g. users from an event table); keys that are
still repeated after that carry conflicting attributes and are reported by the
``unique`` check, never dropped here.  ``joins`` adds snowflake arms
(customer -> nation -> region) through guarded many-to-one joins.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame

from starmart.plans.joins import many_to_one
from starmart.spec import Dimension, MartSpec, validate_dimension


def dimension_rows(dim: Dimension, tables: Mapping[str, DataFrame], columns: Sequence[str] | None = None,
                   broadcast_rows: int | None = None, split_hot: bool = True) -> DataFrame:
    """Source rows of ``dim`` with its snowflake arms joined, projected to
    ``columns`` (identical projected rows collapsed when ``dim.dedupe``)."""
    validate_dimension(dim, tables)
    wanted = list(columns) if columns is not None else list(dim.columns)
    df = tables[dim.source_table]
    for j in dim.joins:
        right = tables[j.table]
        df = many_to_one(df, right, j.left_on, j.right_on, j.how,
                         what=f"dimension '{dim.name}' arm '{j.table}'", broadcast_rows=broadcast_rows,
                         split_hot=False)  # a dimension's rows; AQE splits an arm that many share
    df = df.select(*wanted)
    return df.distinct() if dim.dedupe else df


def build_dimension(dim: Dimension, tables: Mapping[str, DataFrame], broadcast_rows: int | None = None,
                    split_hot: bool = True) -> DataFrame:
    return dimension_rows(dim, tables, broadcast_rows=broadcast_rows, split_hot=split_hot)


def build_all_dimensions(spec: MartSpec, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every dimension of the spec, keyed by name (lazy DataFrames)."""
    return {d.name: build_dimension(d, tables) for d in spec.dimensions}
