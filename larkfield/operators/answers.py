"""Result sets built on search: context, similar items, paths, comparisons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions import arrays as ar
from larkfield.functions import numbers as nm
from larkfield.functions import text as tx
from larkfield.operators import search
from larkfield.operators.ranking import keep_first, top_per_group
from larkfield.session import durable


def similar_items(items: DataFrame, seeds: DataFrame, lex: search.Lexicon, n: int, exclude: DataFrame | None = None,
                  pool: int = 300) -> DataFrame:
    """Items like a seed: nearest ``pool`` by full-field cosine, rescored with topics, category, type and title.

    ``seeds(query_id, seed_id, query)``; a null query compares with the seed's
    own title and topics. Only the terms of the seeds are scored.
    """
    own = seeds.select("query_id", F.col("seed_id").alias("item_id"))
    barred = own if exclude is None else own.unionByName(exclude.select("query_id", "item_id"))
    # So many more rows that the pool is full without those passed over.
    more = barred.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    near = search.item_cosines(items, own, lex, pool + more).join(barred, ["query_id", "item_id"], "left_anti")
    near = search.top_n(near, pool, "cosine").drop("rank")
    s = items.select(F.col("item_id").alias("seed_id"), F.col("title").alias("_st"), F.col("topics").alias("_sp"),
                     F.col("category").alias("hint"), F.col("type").alias("_sy"))
    c = near.join(seeds.select("query_id", "seed_id", "query"), "query_id").join(s, "seed_id").join(
        items.select("item_id", "title", "topics", "category", "type"), "item_id")
    c = c.withColumns({"_q": F.array_distinct(tx.query_tokens(F.coalesce("query", "_st"), lex.stop)),
                       "_n": tx.normalize_text(F.col("title"))})
    c = c.withColumns({
        "_cat": nm.category_bonus(F.col("hint"), F.col("category"), lex.related, tx.words(F.col("hint")), tx.words(F.col("category"))),
        "topic_jaccard": ar.jaccard(F.col("_sp"), F.col("topics")),
        "topic_contain": ar.containment(F.when(F.col("query").isNull(), F.col("_sp")).otherwise(F.col("_q")), F.col("topics")),
        "type_match": (F.col("type") == F.col("_sy")).cast("double"),
        "title_overlap": ar.contained_words(F.col("_q"), F.col("_n"))})
    names = {"category": "_cat"}
    score = nm.weighted({names.get(k, k): w for k, w in nm.ITEM_ITEM_WEIGHTS.items()})
    return search.top_n(c.withColumn("score", score), n).select("query_id", "item_id", "cosine", "score", "rank")


def context_results(items: DataFrame, queries: DataFrame, expanded: DataFrame, lex: search.Lexicon, n: int = 8,
                    per_list: int = 15, minimum: float = 0.12) -> DataFrame:
    """Fused rankings of the query, its expansion and matching topics, rescored with fine signals.

    Results under the minimum are dropped, except when nothing better leads.
    """
    # Both forms are searched in one plan: even numbers are the queries, odd ones their expansions.
    both = durable(queries.select((F.col("query_id") * 2).alias("query_id"), "query").unionByName(
        expanded.select((F.col("query_id") * 2 + 1).alias("query_id"), "query")))
    lists = search.lexical_search(items, both, lex, per_list).select(
        F.floor(F.col("query_id") / 2).alias("query_id"), "item_id", "rank")
    topics = search.topic_scores(items, queries, lex).select("query_id", "item_id", F.col("topic_contain").alias("score"))
    lists = lists.unionByName(search.top_n(topics, per_list).select("query_id", "item_id", "rank"))
    fused = durable(search.top_n(search.reciprocal_rank_fusion(lists), n * 4))
    hints = search.with_hints(queries, lex).select("query_id", "hint", F.col("query").alias("_text"))
    c = fused.join(hints, "query_id").join(items.select("item_id", "title", "topics", "category"), "item_id").withColumns({
        "_q": F.array_distinct(tx.query_tokens(F.col("_text"), lex.stop)), "_n": tx.normalize_text(F.col("title"))})
    score = (0.30 * F.least(F.col("score") * 30, F.lit(1.0)) + 0.22 * ar.jaccard(F.col("_q"), F.col("topics"))
             + 0.18 * ar.containment(F.col("_q"), F.col("topics"))
             + 0.15 * F.coalesce((F.col("hint") == F.col("category")).cast("double"), F.lit(0.0))
             + 0.15 * ar.contained_words(F.col("_q"), F.col("_n")))
    ranked = top_per_group(c.withColumn("final", score), ["query_id"], search.by_score("final"), n * 4, "place")
    kept = ranked.filter((F.round("final", 3) >= minimum) | (F.col("place") == 1))
    return top_per_group(kept, ["query_id"], [F.col("place")], n).select(
        "query_id", "item_id", F.col("final").alias("score"), "rank")


def answer_set(sources: DataFrame, similar: DataFrame, items: DataFrame, n: int = 6) -> DataFrame:
    """Sources followed by similar items, each once, with the category most sources share."""
    both = sources.select("query_id", "item_id", F.lit(0).alias("stage"), "rank").unionByName(
        similar.select("query_id", "item_id", F.lit(1).alias("stage"), "rank"))
    once = keep_first(both, ["query_id", "item_id"], [F.col("stage"), F.col("rank")])
    picked = top_per_group(once, ["query_id"], [F.col("stage"), F.col("rank")], n, "place")
    leading = sources.filter("rank <= 5").join(items.select("item_id", "category"), "item_id").groupBy(
        "query_id", "category").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"))
    top = keep_first(leading, ["query_id"], [F.desc("_n"), F.col("_first")]).select("query_id", F.col("category").alias("main_category"))
    return picked.join(top, "query_id", "left").select("query_id", "item_id", "stage", "place", "main_category")


def learning_path(ranked: DataFrame, levels: DataFrame, backfill: DataFrame, quotas: Mapping[int, int]) -> DataFrame:
    """Stages by difficulty with quotas: ranked items first, then level-mates of the category.

    ``ranked(query_id, item_id, rank)``, ``levels(item_id, level)``,
    ``backfill(query_id, item_id, level, matches, topic)``. Back-fill prefers
    items that match the query and takes one per main topic before repeats.
    """
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    have = top_per_group(ranked.join(levels, "item_id"), ["query_id", "level"], [F.col("rank")], max(quotas.values()), "pos")
    have = have.filter(F.col("pos") <= quota[F.col("level")])
    taken = have.groupBy("query_id", "level").agg(F.count(F.lit(1)).alias("_n"))
    extra = backfill.join(have.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    # A topic seen before comes after all new topics; only the head of each topic can matter.
    most = max(quotas.values())
    heads = top_per_group(extra, ["query_id", "level", "topic"], [F.desc("matches"), F.col("item_id")], most, "_repeat")
    late = F.when(F.col("topic") == "", 0).otherwise((F.col("_repeat") > 1).cast("int"))
    fill = top_per_group(heads.withColumn("_late", late), ["query_id", "level"],
                         [F.col("_late"), F.desc("matches"), F.col("item_id")], most, "pos")
    fill = fill.join(taken, ["query_id", "level"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(
        F.col("pos") + F.col("_n") <= quota[F.col("level")])
    out = have.select("query_id", "level", "item_id", F.lit(0).alias("source"), "pos").unionByName(
        fill.select("query_id", "level", "item_id", F.lit(1).alias("source"), "pos"))
    w = Window.partitionBy("query_id", "level").orderBy("source", "pos")
    return out.withColumn("place", F.row_number().over(w)).drop("pos")
