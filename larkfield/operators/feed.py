"""Feed assembly and per-row counts as aggregates joined back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.session import durable


def with_counts(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Add ``n_<name>`` per child table, zero when there are none.

    Each child is aggregated on the key first, so a parent with very many
    children costs one row in the join.
    """
    out = parent
    for name, (child, child_key) in children.items():
        counts = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(counts, key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def with_flag(df: DataFrame, keys: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Boolean column: does the row's key occur in ``keys``."""
    marked = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def resolve_shares(posts: DataFrame, key: str, shared_from: str) -> DataFrame:
    """Add ``origin``: the first post of every share chain, by pointer doubling.

    Each round doubles the distance covered, so a chain of length n needs about
    log2(n) rounds. Rounds are cut with durable copies and stop when nothing moves.
    A post whose parent is unknown ends its chain at that parent. Posts that share each other in a
    circle have no origin; they are still moving after enough rounds for any chain, which is an error.
    """
    rounds = posts.count().bit_length() + 1
    links = posts.select(F.col(key).alias("_id"), F.coalesce(shared_from, key).alias("_up"))
    for _ in range(rounds):
        step = links.select(F.col("_id").alias("_up"), F.col("_up").alias("_next"))
        moved = durable(links.join(step, "_up", "left").select(
            "_id", F.coalesce("_next", "_up").alias("_up"), (F.col("_next") != F.col("_up")).alias("_moved")))
        links = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    else:
        raise ValueError("posts share each other in a circle")
    return posts.join(links.select(F.col("_id").alias(key), F.col("_up").alias("origin")), key)
