"""Operators on directed edges read as undirected, and on pair-keyed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Both directions of every edge, so lookups are equi-joins instead of ORs."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    out = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"),
                       F.lit("sent").alias("direction"), *rest)
    back = edges.select(F.col(dst).alias("node"), F.col(src).alias("neighbour"),
                        F.lit("received").alias("direction"), *rest)
    return out.unionByName(back)


def friendship_state(edges: DataFrame, src: str, dst: str, status: str) -> DataFrame:
    """Per ordered pair: friends, pending_sent or pending_received, and whether it is mutual."""
    both = neighbours(edges, src, dst)
    sent = F.max(F.when(F.col("direction") == "sent", F.lit(1)).otherwise(0))
    received = F.max(F.when(F.col("direction") == "received", F.lit(1)).otherwise(0))
    accepted = F.max((F.col(status) == "accepted").cast("int"))
    return both.groupBy("node", "neighbour").agg(sent.alias("_s"), received.alias("_r"), accepted.alias("_a")).select(
        "node", "neighbour",
        F.when(F.col("_a") == 1, "friends").when(F.col("_s") == 1, "pending_sent")
        .otherwise("pending_received").alias("state"),
        (F.col("_s") + F.col("_r") == 2).alias("mutual"))


def with_pair_key(messages: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``low``/``high`` so that both directions of a thread share one key."""
    return messages.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})
