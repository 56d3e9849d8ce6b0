"""Sources: anything that yields ``{table name: DataFrame}``.

A reader is a lazy mapping from names to DataFrames.  Parquet directories are
read with ``spark.read.parquet`` (vectorised, filter/column pushdown), catalog
tables with ``spark.table``.  No data is touched until a job runs.
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from starmart.errors import UnknownTableError

def parquet_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the ``<name>.parquet`` files and folders directly under ``root``,
    listed through the file system that Spark reads ``root`` with."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries]
    return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))


class ParquetSource(Mapping[str, DataFrame]):
    """``{name: DataFrame}`` over ``<root>/<name>.parquet`` (file or folder).

    DataFrames are created on first access and kept, so repeated lookups share
    one logical relation (Spark can then reuse its scan/exchange).  Without
    ``names`` the folder is listed, in whatever store it is.
    """

    def __init__(self, spark: SparkSession, root: str, names: Iterable[str] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._names = tuple(names if names is not None else parquet_names(spark, self.root))
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise UnknownTableError(
                f"Table '{name}' not found in {self.root}. Available tables: {sorted(self._names)}."
            )
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


class CatalogSource(Mapping[str, DataFrame]):
    """``{name: DataFrame}`` over the base tables of a catalog database.

    Views and temporary tables are excluded, names are sorted; an empty
    database gives an empty mapping.
    """

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark = spark
        self.database = database or spark.catalog.currentDatabase()
        tables = spark.catalog.listTables(self.database)
        self._names = tuple(sorted(
            t.name for t in tables
            if not t.isTemporary and (t.tableType or "").upper() in ("MANAGED", "EXTERNAL")
        ))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise UnknownTableError(
                f"Table '{name}' not found in database '{self.database}'. "
                f"Available tables: {list(self._names)}."
            )
        return self.spark.table(f"`{self.database}`.`{name}`")

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``(table_name)`` of the base tables of a catalog database, sorted; views
    and temporary tables excluded; an empty database gives no rows."""
    names = list(CatalogSource(spark, database))
    return spark.createDataFrame([(n,) for n in names], "table_name string").orderBy("table_name")


def load_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> ParquetSource:
    """``{name: DataFrame}`` over the parquet tables under ``root``."""
    return ParquetSource(spark, root, names)


def from_frames(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Use already-built DataFrames (tests, fixtures) as a source."""
    return dict(frames)


def register_external_tables(spark: SparkSession, database: str, root: str, names: Iterable[str],
                             location: str) -> CatalogSource:
    """Register ``<root>/<name>.parquet`` as external catalog tables of
    ``database`` (created at ``location`` if missing).  Metadata only: the
    files are neither copied nor written."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    for n in names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{n}` USING parquet "
                  f"LOCATION '{root.rstrip('/')}/{n}.parquet'")
    return CatalogSource(spark, database)
