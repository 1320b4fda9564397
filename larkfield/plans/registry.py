"""Query registry: one name, one Spark plan, optionally one SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


PlanFn = Callable[[Tables], DataFrame]
PLANS: dict[str, PlanFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[PlanFn], PlanFn]:
    """Register a plan; ``sql`` is the text it is compared with."""

    def wrap(fn: PlanFn) -> PlanFn:
        if name in PLANS:
            raise ValueError(f"query {name} is already registered")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap
