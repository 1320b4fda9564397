"""Data-quality checks: one aggregate pass per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fact_check(df: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Null keys, negative amounts, and whether both are zero."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    negative = F.lit(False)
    for a in amounts:
        negative = negative | F.coalesce(F.col(a) < 0, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(null_key).alias("null_keys"),
        F.count_if(negative).alias("negative_amounts"),
    ).withColumn("passed", (F.col("null_keys") == 0) & (F.col("negative_amounts") == 0))


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and null keys; passes when every row has its own key."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(key).alias("n_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
    ).withColumn("passed", F.col("n_rows") == F.col("n_keys"))


def not_null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column in one row, and whether there are none."""
    out = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(f"null_{c}") == 0)
    return out.withColumn("passed", ok)


def rule_report(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Failing rows per declared ``column -> [not_null, unique]`` rule, in one pass.

    ``unique`` counts the surplus rows of repeated non-null values.
    """
    aggs, entries = [], []
    for column, checks in rules.items():
        for check in checks:
            name = f"{column}__{check}"
            if check == "not_null":
                aggs.append(F.count_if(F.col(column).isNull()).alias(name))
            elif check == "unique":
                aggs.append((F.count(column) - F.countDistinct(column)).alias(name))
            else:
                raise ValueError(f"unknown check {check}")
            entries.append((column, check, name))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"),
                              F.col(n).alias("failures")) for c, k, n in entries])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def domain_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each named condition (null counts as broken)."""
    wide = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule_name"), F.col(n).alias("failures")) for n in rules])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """How many child rows have no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
