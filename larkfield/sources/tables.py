"""Layered tables: extracts, file layers, keyed upserts, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkfield.operators.catalog import number_rows
from larkfield.operators.ranking import keep_first
from larkfield.session import durable


# ------------------------------------------------------------------- extracts

def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted, comma-separated text with one header row; quotes may hold line breaks."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: object = None,
                 upper: object = None, parts: int = 64, fetch_size: int = 10000, **extra: str) -> dict[str, str]:
    """Reader options of a whole-table extract, split on a column so that many tasks read."""
    out = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if partition_column is not None:
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                "numPartitions": str(parts)}
    return out


def read_jdbc(spark: SparkSession, **kw) -> DataFrame:
    """Whole table from a SQL source."""
    return spark.read.format("jdbc").options(**jdbc_options(**kw)).load()


# --------------------------------------------------------------------- layers

@dataclass(frozen=True)
class TableRef:
    """Place of a table: layer, group and name; the layer prefix of a name is dropped."""

    layer: str
    group: str
    name: str

    @property
    def table(self) -> str:
        return self.name.removeprefix(f"{self.layer}_")

    def path(self, root: str) -> str:
        return f"{root}/{self.layer}/{self.group}/{self.table}"


def write_layer(df: DataFrame, root: str, ref: TableRef, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(ref.path(root))


def read_layer(spark: SparkSession, root: str, ref: TableRef) -> DataFrame:
    return spark.read.parquet(ref.path(root))


def save_table(df: DataFrame, ref: TableRef, mode: str = "overwrite") -> None:
    """Managed table ``layer.table``."""
    df.sparkSession.sql(f"CREATE SCHEMA IF NOT EXISTS {ref.layer}")
    df.write.mode(mode).saveAsTable(f"{ref.layer}.{ref.table}")


def ingest_bronze(sources: Mapping[str, DataFrame], root: str, group: str, private: Sequence[str] = ()) -> list[TableRef]:
    """Write every source table to the raw layer, leaving private tables out."""
    refs = []
    for name, df in sources.items():
        if name in private:
            continue
        ref = TableRef("bronze", group, f"bronze_{name}")
        write_layer(df, root, ref)
        refs.append(ref)
    return refs


def load_if_empty(spark: SparkSession, df: DataFrame, path: str, force: bool = False) -> bool:
    """Write only when the target holds no rows; ``force`` replaces it. Returns whether it wrote."""
    if not force:
        try:
            if not spark.read.parquet(path).isEmpty():
                return False
        except Exception as exc:  # noqa: BLE001 - a missing path means nothing is loaded yet
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
    df.write.mode("overwrite").parquet(path)
    return True


# -------------------------------------------------------------------- upserts

def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], on_duplicate: str = "error",
           latest: Sequence[Column] = ()) -> DataFrame:
    """Target with source rows replacing or joining it by key.

    A key that repeats in the source is an error, or keeps its first row under
    ``latest`` with ``on_duplicate="latest"``.
    """
    if on_duplicate == "latest":
        source = keep_first(source, keys, latest)
    else:
        source = durable(source)
        if not source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"source repeats keys {list(keys)}")
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return source.unionByName(kept.select(*source.columns) if set(kept.columns) == set(source.columns) else kept,
                              allowMissingColumns=True)


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many source keys are new and how many exist."""
    rows = source.select(*keys).distinct()
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, list(keys), "left").agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if("_known").alias("updated"))


def append_with_ids(target: DataFrame, rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Target plus new rows numbered after its largest id."""
    top = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("v")).scalar()
    fresh = number_rows(rows, order, key, F.lit(1)).withColumn(key, F.col(key) + top)
    return target.unionByName(fresh.select(*target.columns))


# ------------------------------------------------------------------ snapshots

class Snapshots:
    """Versions of one table as folders plus a manifest of commits.

    One writer at a time. A commit first writes the new rows, then its manifest
    entry; readers follow the manifest, so half-written folders are never seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def history(self) -> DataFrame:
        return self.spark.read.schema("version long, committed timestamp, folder string").parquet(f"{self.root}/manifest")

    def _next(self) -> int:
        try:
            return self.history().agg(F.max("version")).first()[0] + 1
        except Exception as exc:  # noqa: BLE001 - no manifest yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return 1

    def commit(self, df: DataFrame) -> int:
        version = self._next()
        folder = f"{self.root}/data/version={version}"
        df.write.mode("overwrite").parquet(folder)
        entry = self.spark.range(1).select(F.lit(version).cast("long").alias("version"),
                                           F.current_timestamp().alias("committed"), F.lit(folder).alias("folder"))
        entry.write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def read(self, version: int | None = None, as_of=None) -> DataFrame:
        """Latest version, a given one, or the last one committed up to a time."""
        rows = self.history()
        if version is not None:
            rows = rows.filter(F.col("version") == version)
        if as_of is not None:
            rows = rows.filter(F.col("committed") <= F.lit(as_of))
        found = rows.orderBy(F.desc("version")).first()
        if found is None:
            raise ValueError("no such version")
        return self.spark.read.parquet(found["folder"])

    def update(self, where: Column, values: Mapping[str, Column]) -> int:
        df = self.read()
        return self.commit(df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, where: Column) -> int:
        return self.commit(self.read().filter(~F.coalesce(where, F.lit(False))))

    def insert(self, rows: DataFrame) -> int:
        return self.commit(self.read().unionByName(rows, allowMissingColumns=True))

    def add_column(self, name: str, kind: str) -> int:
        return self.commit(self.read().withColumn(name, F.lit(None).cast(kind)))
