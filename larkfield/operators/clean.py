"""Row cleaning between the raw and the trusted layer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import keep_first

Transform = Callable[[DataFrame], DataFrame]


def whole_distinct(df: DataFrame) -> DataFrame:
    """Rows without any null, each kept once."""
    return df.na.drop().dropDuplicates()


def distinct_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows without any null, one per key under an explicit order."""
    return keep_first(df.na.drop(), keys, order)


def with_whole_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast float columns to int, cutting the fraction."""
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def with_money(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Round money columns half up to ``digits`` places."""
    return df.withColumns({c: F.round(c, digits).cast("double") for c in columns})


def inside_box(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns all lie in their closed interval."""
    for name, (low, high) in bounds.items():
        df = df.filter(F.col(name).between(low, high))
    return df


def run_registry(sources: Mapping[str, DataFrame], steps: Mapping[str, tuple[str, Transform]]) -> dict[str, DataFrame]:
    """Apply ``name -> (source, transform)`` lazily; nothing is counted or written here."""
    return {name: transform(sources[source]) for name, (source, transform) in steps.items()}


def fill_blanks(df: DataFrame, defaults: Mapping[str, str], blanks: Sequence[str]) -> DataFrame:
    """Replace nulls, blanks and null-like words with per-column defaults."""
    words = [b.lower() for b in blanks]
    changes = {}
    for name, default in defaults.items():
        text = F.trim(F.col(name).cast("string"))
        empty = F.col(name).isNull() | (text == "") | F.lower(text).isin(words)
        changes[name] = F.when(empty, F.lit(default)).otherwise(F.col(name))
    return df.withColumns(changes)


def changed_counts(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row: how many rows each cleaning changed (old, new), plus the total."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(~old.eqNullSafe(new)).alias(name) for name, (old, new) in pairs.items()
    ])


def kept_and_dropped(df: DataFrame, keep: Column) -> DataFrame:
    """One row: rows that pass and fail a condition (null fails)."""
    ok = F.coalesce(keep, F.lit(False))
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
