"""Relevance judgments: query topics, graded labels, labelling samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.operators.catalog import number_rows
from larkfield.operators.ranking import top_per_group


def medium_topics(items: DataFrame, category: str, topics: str, per_category: int, low: int = 20, high: int = 320,
                  max_total: int = 750, fill: int = 5) -> DataFrame:
    """Topics of medium frequency per category; gaps are filled from any topic seen ``fill`` times."""
    counts = (items.select(category, F.explode(topics).alias("topic")).groupBy(category, "topic")
              .agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    tier = (F.when(F.col("n").between(low, high) & (F.col("total") <= max_total), 0).when(F.col("n") >= fill, 1))
    tiers = counts.join(total, "topic").withColumn("tier", tier).filter(F.col("tier").isNotNull())
    return top_per_group(tiers, [category], [F.col("tier"), F.desc("n"), F.col("topic")], per_category, "pos")


def grade(items: DataFrame, item: str, category: str, topics: str, queries: DataFrame) -> DataFrame:
    """Grade 2 when topic and category match, 1 when only the topic does.

    ``queries``: ``query_id, category, topics`` (array). Pairs without a shared
    topic have grade 0 and are not listed.
    """
    by_topic = items.select(F.col(item).alias("item_id"), F.col(category).alias("_cat"), F.explode(topics).alias("topic"))
    wanted = queries.select("query_id", F.col("category").alias("_want"), F.explode("topics").alias("topic"))
    return (by_topic.join(wanted, "topic").groupBy("query_id", "item_id")
            .agg(F.max(F.when(F.col("_cat") == F.col("_want"), 2).otherwise(1)).alias("grade")))


def seeded(*parts, seed: int):
    """Order column that is random but does not depend on partitions."""
    return F.xxhash64(*parts, F.lit(seed))


def random_unlisted(needs: DataFrame, listed: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """``need`` seeded random items per query that are not listed for it.

    ``needs(query_id, need)``, ``listed(query_id, item_id)``. Every query walks
    one seeded ring of all items from its own start. The first ``need +
    listed`` places hold enough unlisted items, so no query-by-item table is built.
    """
    ring = number_rows(items.select("item_id").distinct(), [seeded("item_id", seed=seed), F.col("item_id")], "_slot", 0)
    size = ring.agg(F.count(F.lit(1)).alias("v")).scalar()
    counts = listed.groupBy("query_id").agg(F.count(F.lit(1)).alias("_listed"))
    walks = (needs.join(counts, "query_id", "left").withColumn("_size", size)
             .withColumn("_start", F.pmod(seeded("query_id", seed=seed + 1), F.col("_size")))
             .withColumn("_len", F.least(F.col("need") + F.coalesce("_listed", F.lit(0)), F.col("_size"))))
    steps = walks.select("query_id", "need", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_len") - 1)).alias("_step"),
                         "_start", "_size")
    visited = steps.withColumn("_slot", F.pmod(F.col("_start") + F.col("_step"), F.col("_size"))).join(ring, "_slot")
    free = visited.join(listed.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("_step")
    return free.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("need")).select("query_id", "item_id")


def labelling_sample(qrels: DataFrame, items: DataFrame, per_query: int, seed: int) -> DataFrame:
    """Per query a third of grade 2, a third of grade 1, and the rest unlisted items."""
    third = max(1, per_query // 3)
    picked = (top_per_group(qrels, ["query_id", "grade"], [seeded("query_id", "item_id", seed=seed), F.col("item_id")], third)
              .select("query_id", "item_id", "grade"))
    needs = picked.groupBy("query_id").agg(F.greatest(F.lit(1), per_query - F.count(F.lit(1))).alias("need"))
    negatives = random_unlisted(needs, qrels, items, seed)
    return picked.unionByName(negatives.withColumn("grade", F.lit(0)))
