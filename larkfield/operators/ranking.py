"""Orderings inside groups and over whole tables that survive hot groups.

``row_number() <= k`` filters are planned with a partial group limit, so at
most ``k`` rows per group and map task are shuffled. Full positions are found
in two levels (bucket offsets, then positions inside a bucket), so one group
is never sorted by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key under ``order``; ``rank`` counts from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first under an explicit order."""
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top ``k``: each partition keeps ``k`` rows before the merge."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows under a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def group_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                    name: str = "pos", total: str | None = None) -> DataFrame:
    """Position (from 1) of every row in its group, splitting groups by ``bucket``.

    ``bucket`` must not decrease along ``order``. Keys must not be null.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = (tagged.join(offsets, [*keys, "_bucket"])
           .withColumn(name, F.col("_before") + F.row_number().over(inside)))
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_before", "_total")


#: Split points read from the sketch; a power of two. A bucket takes about ``ROWS_PER_BUCKET`` rows until all are in use.
FINEST = 4096
ROWS_PER_BUCKET = 250_000
#: Values that the sketch keeps per level: a rank is off by far less than 1 / FINEST.
SKETCH_SIZE = 16384


def split_points(col: Column, rows_per_bucket: int = ROWS_PER_BUCKET, fewest: int = 64) -> Column:
    """Aggregate: ascending values that part the rows into buckets of about equal size, the more the more rows there are.

    One mergeable quantile sketch gives both the number of rows and the values.
    The number of buckets is a power of two between ``fewest`` and ``FINEST``.
    """
    ranks = ",".join(repr(i / FINEST) for i in range(1, FINEST))
    sketch = F.kll_sketch_agg_double(col.cast("double"), F.lit(SKETCH_SIZE))
    n = F.kll_sketch_get_n_double(sketch)
    values = F.kll_sketch_get_quantile_double(sketch, F.expr(f"cast(split('{ranks}', ',') as array<double>)"))
    wanted = F.least(F.greatest(n / rows_per_bucket, F.lit(float(fewest))), F.lit(float(FINEST)))
    stride = F.floor(F.lit(FINEST) / F.pow(F.lit(2), F.ceil(F.log2(wanted)))).cast("int")
    return F.when(n > 0, F.filter(values, lambda _, i: (i + 1) % stride == 0)).otherwise(F.array().cast("array<double>"))


def place_among(cuts: Column, value: Column) -> Column:
    """Number of ascending ``cuts`` that are not over ``value``, by halving."""
    steps = F.array(*[F.lit(FINEST >> i) for i in range(FINEST.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value), at + step).otherwise(at))


def with_range_bucket(df: DataFrame, col: str, rows_per_bucket: int = ROWS_PER_BUCKET, name: str = "_bucket") -> DataFrame:
    """Add a bucket number along a numeric column with about equal row counts per bucket; more rows make more buckets.

    The split points come from a scalar subquery; they steer the split only, never the result.
    """
    cuts = df.agg(split_points(F.col(col), rows_per_bucket).alias("v")).scalar()
    return df.withColumn("_cuts", cuts).withColumn(name, place_among(F.col("_cuts"), F.col(col).cast("double"))).drop("_cuts")


def running_counts(df: DataFrame, value: str, measures: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative sums of ``measures`` along distinct ``value``s per key, in two levels.

    ``df`` holds one row per key and value. Adds ``cum_<m>`` (this value
    included) and ``all_<m>``. Only bucket totals, not rows, meet in one task.
    """
    tagged = with_range_bucket(df, value, rows_per_bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    part = list(keys) or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*part)
    offsets = sizes.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_s_{m}").over(w), F.lit(0)).alias(f"_b_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(every).alias(f"all_{m}") for m in measures],
    )
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = tagged.join(offsets, [*keys, "_bucket"])
    for m in measures:
        out = out.withColumn(f"cum_{m}", F.col(f"_b_{m}") + F.sum(m).over(inside))
    return out.drop("_bucket", *[f"_b_{m}" for m in measures])


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], rows_per_bucket: int = ROWS_PER_BUCKET,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles of a numeric column, one row per key.

    Values are counted first, so ties cost one row; each wanted rank is then
    read from the cumulative counts.
    """
    values = (df.filter(F.col(col).isNotNull())
              .groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("n")))
    cum = running_counts(values, "_v", ["n"], rows_per_bucket, keys)
    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("all_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"{name}_part"))
    rows = cum.groupBy(*keys).agg(*picks)
    return rows.select(*keys, *[
        (F.col(f"{n}_lo") + F.col(f"{n}_part") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n)
        for n in probs
    ])
