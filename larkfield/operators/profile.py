"""Summaries of tables, columns and result sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.operators.ranking import exact_quantiles, keep_first
from larkfield.session import durable


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def column_profile(df: DataFrame, numeric: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Per column: nulls, distinct values, and for numbers mean, spread and range.

    Distinct values are counted from one long table, so each column adds rows
    to one shuffle instead of an extra expansion of the input.
    """
    columns = [*numeric, *other]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("text"),
                 (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"))
        for c in columns])).alias("c")).select("c.*")
    values = long.groupBy("column_name", "text").agg(
        F.count(F.lit(1)).alias("n"), F.first("num").alias("num"),
        F.sum("num").alias("s"), F.sum(F.col("num") * F.col("num")).alias("ss"))
    out = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("text").alias("distinct_values"),
        (F.sum("s") / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"),
        F.min("num").alias("min"), F.max("num").alias("max"),
        F.sum("s").alias("_s"), F.sum("ss").alias("_ss"),
        F.sum(F.when(F.col("num").isNotNull(), F.col("n"))).alias("_n"))
    spread = F.sqrt((F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))
    return out.withColumn("std", spread).drop("_s", "_ss", "_n")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows in excess of the distinct rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def value_shares(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values with their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("v")).scalar()
    return (counts.select(column, "n", (F.col("n") / total).alias("share"))
            .orderBy(F.desc("n"), F.asc(column)).limit(n))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, with density n / (N * width)."""
    low = df.agg(F.min(column).cast("double").alias("v")).scalar()
    high = df.agg(F.max(column).cast("double").alias("v")).scalar()
    total = df.agg(F.count(column).alias("v")).scalar()
    slot = F.least(F.floor((F.col(column).cast("double") - low) / (high - low) * bins), F.lit(bins - 1))
    counts = (df.filter(F.col(column).isNotNull()).groupBy(slot.cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    width = (high - low) / bins
    return counts.select("bin", "n", (low + F.col("bin") * width).alias("bin_start"),
                         (F.col("n") / (total * width)).alias("density"))


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key; equal counts resolve to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return keep_first(counts, keys, [F.desc("n"), F.asc(value)])


def fences(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, reach: float = 1.5) -> DataFrame:
    """Quantile fences of one column as a single row (``fence_low``, ``fence_high``)."""
    q = exact_quantiles(df, column, {"q_low": low, "q_high": high})
    gap = F.col("q_high") - F.col("q_low")
    return q.select("q_low", "q_high", (F.col("q_low") - reach * gap).alias("fence_low"),
                    (F.col("q_high") + reach * gap).alias("fence_high"))


def split_by_fences(df: DataFrame, column: str, **kw) -> DataFrame:
    """Add ``outlier``: is the value outside the fences of its column?"""
    box = fences(df, column, **kw).select(F.struct("fence_low", "fence_high").alias("v")).scalar()
    value = F.col(column)
    return (df.withColumn("_box", box)
            .withColumn("outlier", (value < F.col("_box.fence_low")) | (value > F.col("_box.fence_high")))
            .drop("_box"))


def remove_outliers(df: DataFrame, columns: Sequence[str], **kw) -> DataFrame:
    """Drop outliers column by column; each column sees the rows left by the one before."""
    for c in columns:
        # The input is read once per fence, so it is written once first.
        df = split_by_fences(durable(df), c, **kw).filter(~F.col("outlier")).drop("outlier")
    return df


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; the built-in is the population estimator."""
    n = F.count(value).cast("double")
    return F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)


def share_of_total(column: str) -> Column:
    """Column divided by its sum over a table that is already aggregated and small."""
    return F.col(column) / F.sum(column).over(Window.partitionBy(F.lit(0)))
