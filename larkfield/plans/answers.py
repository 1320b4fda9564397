"""Result sets on top of search: similar items, context, paths, features, learned ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions import numbers as nm
from larkfield.functions import text as tx
from larkfield.operators import answers as an
from larkfield.operators import catalog as cat
from larkfield.operators import clean, dense, learn, neighbours, search
from larkfield.operators import evaluation as ev
from larkfield.operators import query_text as qt
from larkfield.operators.judgments import random_unlisted, seeded
from larkfield.operators.ranking import keep_first, top_per_group
from larkfield.plans.entities import event_items, with_entities
from larkfield.plans.registry import Tables, query
from larkfield.plans.search import (BM25_SQL, ITEMS_SQL, LEXICON, PAIRS_SQL, QUERY_GRAMS, field_sql, gram_counts, items, queries,
                                    query_vectors, shown, top_sql, vectors, vocab_sql, weight_sql)
from larkfield.plans.text import bare_sql, norm_sql, tokens_sql, topics_sql
from larkfield.session import durable


def _seeds(t: Tables) -> DataFrame:
    """Best BM25 document of each benchmark query."""
    scores = search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
    best = search.top_n(scores, 1)
    return durable(best.select("query_id", F.col("item_id").alias("seed_id")))


SEED_SQL = f"""seed AS MATERIALIZED (SELECT query_id, item_id AS seed_id FROM ({top_sql('bm25', 'bm25', 1)}))
, {gram_counts('fg', 'item_id', field_sql('full'))}, {vocab_sql('fv', 'fg')}, {weight_sql('fw', 'item_id', 'fg', 'fv')}
, cosines AS MATERIALIZED (SELECT query_id, seed_id, b.item_id, sum(a.w * b.w) AS cosine FROM seed JOIN fw a ON a.item_id = seed_id
    JOIN fw b ON a.term = b.term AND b.item_id <> seed_id GROUP BY 1, 2, 3)"""


ALL_PAIRS_SQL = f"""{gram_counts('fg', 'item_id', field_sql('full'))}, {vocab_sql('fv', 'fg')}, {weight_sql('fw', 'item_id', 'fg', 'fv')}
, every AS (SELECT a.item_id AS query_id, b.item_id, sum(a.w * b.w) AS cosine FROM fw a JOIN fw b ON a.term = b.term AND a.item_id <> b.item_id
    GROUP BY 1, 2)"""


@query("i8_item_neighbours", f"WITH {ITEMS_SQL}, {ALL_PAIRS_SQL} {top_sql('every', 'cosine', 10)}")
def item_neighbours(t: Tables) -> DataFrame:
    """The ten nearest documents of every document by the full-field cosine."""
    weights = durable(search.full_weights(items(t), LEXICON))
    near = neighbours.nearest_items(weights, 10, spent=[weights])
    return shown(near.withColumnsRenamed({"item_id": "query_id", "neighbour": "item_id", "cosine": "score"}))


ITEM_SCORE_SQL = f"""near AS (SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, item_id) <= 300)
, parts AS MATERIALIZED (SELECT query_id, i.item_id, cosine,
    CASE WHEN s.category = i.category THEN 1 WHEN s.category IN ('fr', 'es') AND i.category IN ('fr', 'es') THEN 0.55 ELSE 0 END AS cat,
    CASE WHEN len(s.topics) > 0 AND len(i.topics) > 0 THEN len(list_intersect(s.topics, i.topics)) / len(list_distinct(list_concat(s.topics, i.topics))) ELSE 0 END AS jac,
    CASE WHEN len(s.topics) > 0 THEN len(list_intersect(s.topics, i.topics)) / len(s.topics) ELSE 0 END AS con,
    (s.type = i.type)::INT AS typ,
    CASE WHEN len(st.q) > 0 THEN len(list_filter(st.q, lambda w: contains(n.nt, w))) / len(st.q) ELSE 0 END AS tit
    FROM near JOIN items s ON s.item_id = seed_id JOIN items i ON i.item_id = near.item_id
    JOIN (SELECT item_id, list_distinct({tokens_sql('title', 3)}) AS q FROM items) st ON st.item_id = seed_id
    JOIN (SELECT item_id, {norm_sql('title')} AS nt FROM items) n ON n.item_id = i.item_id)
, similar_items AS MATERIALIZED (SELECT *, least(1, 0.52 * cosine + 0.2 * cat + 0.13 * jac + 0.08 * con + 0.04 * typ + 0.03 * tit) AS score FROM parts)"""


@query("i19_similar_to_seed", f"WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}, {SEED_SQL}, {ITEM_SCORE_SQL} {top_sql('similar_items', 'score', 5)}")
def similar_to_seed(t: Tables) -> DataFrame:
    return shown(an.similar_items(items(t), _seeds(t).withColumn("query", F.lit(None).cast("string")), LEXICON, 5))


@query("h4_8_item_item_score", f"""WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}, {SEED_SQL}, {ITEM_SCORE_SQL}
    SELECT query_id, item_id, round(cosine, 6) AS cosine, round(score, 6) AS score FROM similar_items""")
def item_item_score(t: Tables) -> DataFrame:
    near = an.similar_items(items(t), _seeds(t).withColumn("query", F.lit(None).cast("string")), LEXICON, 300)
    return near.select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query("h4_7_category_bonus", """
    SELECT a.p_type AS type_a, b.p_type AS type_b, round(cast(CASE WHEN a.p_type = b.p_type THEN 1
        WHEN (a.p_type, b.p_type) IN (('PROMO', 'ECONOMY'), ('ECONOMY', 'PROMO')) THEN 0.55 ELSE 0 END AS DOUBLE), 2) AS bonus, count(*) AS n
    FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 GROUP BY 1, 2""")
def category_bonus(t: Tables) -> DataFrame:
    """Bonus between the types of parts with neighbouring numbers."""
    a = t.part.select("p_partkey", F.col("p_type").alias("type_a"))
    b = t.part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_type").alias("type_b"))
    bonus = nm.category_bonus(F.col("type_a"), F.col("type_b"), [("PROMO", "ECONOMY")], tx.words(F.col("type_a")), tx.words(F.col("type_b")))
    return a.join(b, "p_partkey").groupBy("type_a", "type_b", bonus.alias("bonus")).agg(F.count(F.lit(1)).alias("n"))


@query("c18_query_item_matches", f"""WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}
    SELECT query_id, count(*) AS n_items, round(max(s), 6) AS best FROM bm25_raw GROUP BY 1""")
def query_item_matches(t: Tables) -> DataFrame:
    """Every query against every document that shares a term with it."""
    raw = search.bm25_scores(items(t), queries(t), LEXICON, scaled=False)
    return raw.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.max("bm25"), 6).alias("best"))


@query("k23_top1_accuracy", f"""WITH {ITEMS_SQL}, {PAIRS_SQL}, best AS ({top_sql('lexical', 'score', 1)})
    SELECT count(*) AS n_queries, round(avg(CASE WHEN i.category = h.hint THEN 1.0 WHEN h.hint IN ('fr', 'es') AND i.category IN ('fr', 'es') THEN 0.5
        ELSE 0.0 END::DOUBLE), 6) AS category_accuracy, round(avg(contains(i.description, w)::INT), 6) AS topic_accuracy, round(avg(best.score), 4) AS mean_score
    FROM best JOIN items i USING (item_id) JOIN hints h USING (query_id) JOIN (SELECT query_id, regexp_extract(query, '^\\S+') AS w FROM queries) USING (query_id)""")
def top1_accuracy(t: Tables) -> DataFrame:
    best = search.lexical_search(items(t), queries(t), LEXICON, 1).select("query_id", "item_id", F.round("score", 6).alias("score"))
    asked = search.with_hints(queries(t), LEXICON).select("query_id", "hint", F.regexp_extract("query", r"^\S+", 0).alias("w"))
    c = best.join(items(t).select("item_id", "category", "description"), "item_id").join(asked, "query_id")
    pair = F.col("hint").isin("fr", "es") & F.col("category").isin("fr", "es")
    points = F.when(F.col("category") == F.col("hint"), 1.0).when(pair, 0.5).otherwise(0.0)
    return c.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(points), 6).alias("category_accuracy"),
                 F.round(F.avg(F.contains("description", "w").cast("int")), 6).alias("topic_accuracy"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("i18_context_results")
def context_results(t: Tables) -> DataFrame:
    expanded = queries(t).withColumn("query", qt.expand_query(F.col("query"), {"the": "english text"}, [], tx.STOP_WORDS))
    return shown(an.context_results(items(t), queries(t), expanded, LEXICON))


@query("i21_answer_set")
def answer_set(t: Tables) -> DataFrame:
    """Eight sources per query, similar items to the first, the category of most sources.

    Queries without a source of the wanted type are asked again without it.
    """
    scores = durable(search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
                     .join(items(t).select("item_id", "type"), "item_id"))
    typed = scores.filter("type = 'src3'")
    rest = scores.join(typed.select("query_id").distinct(), "query_id", "left_anti")
    sources = durable(search.top_n(typed.unionByName(rest).drop("type"), 8))
    seeds = sources.filter("rank = 1").select("query_id", F.col("item_id").alias("seed_id")).join(queries(t), "query_id")
    similar = an.similar_items(items(t), seeds, LEXICON, 5, exclude=sources)
    return an.answer_set(sources, similar, items(t))


@query("i22_side_by_side")
def side_by_side(t: Tables) -> DataFrame:
    """Two picks per named thing, counted by type and category."""
    sides = t.benchmark.select((F.col("item_id") * 3).alias("base"), F.split(F.col("text"), r"\.\s").alias("parts"))
    asked = sides.filter(F.size("parts") >= 2).select("base", F.posexplode(F.slice("parts", 1, 3)).alias("side", "query"))
    asked = asked.select((F.col("base") + F.col("side")).alias("query_id"), F.floor(F.col("base") / 3).alias("question"), "side", "query")
    picks = search.top_n(search.bm25_scores(items(t), asked, LEXICON).withColumnRenamed("bm25", "score"), 2)
    c = picks.join(asked.select("query_id", "question", "side"), "query_id").join(items(t).select("item_id", "type", "category"), "item_id")
    return c.groupBy("question", "side", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("n_types"))


@query("e10_learning_path", f"""WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}
    , lv AS MATERIALIZED (SELECT item_id, category, CASE WHEN contains({bare_sql('description')}, 'license') THEN 0
        WHEN contains({bare_sql('description')}, 'que') THEN 2 ELSE 1 END AS level, coalesce(topics[1], '') AS topic FROM items)
    , ranked AS MATERIALIZED ({top_sql('bm25', 'bm25', 8)})
    , quota AS (SELECT * FROM (VALUES (0, 3), (1, 4), (2, 3)) q(level, quota))
    , have AS MATERIALIZED (SELECT query_id, level, item_id, row_number() OVER (PARTITION BY query_id, level ORDER BY rank) AS pos, quota
        FROM ranked JOIN lv USING (item_id) JOIN quota USING (level) QUALIFY pos <= quota)
    , extra AS (SELECT r.query_id, lv.item_id, lv.level, lv.topic FROM (SELECT query_id, category AS c FROM ranked JOIN lv USING (item_id) WHERE rank = 1) r
        JOIN lv ON lv.category = r.c WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.query_id = r.query_id AND h.item_id = lv.item_id))
    , rep AS (SELECT *, row_number() OVER (PARTITION BY query_id, level, topic ORDER BY item_id) AS rp FROM extra)
    , fill AS (SELECT query_id, level, item_id, row_number() OVER (PARTITION BY query_id, level ORDER BY topic <> '' AND rp > 1, item_id) AS pos FROM rep)
    , taken AS (SELECT query_id, level, count(*) AS n FROM have GROUP BY 1, 2)
    , both_parts AS (SELECT query_id, level, item_id, 0 AS source, pos FROM have
        UNION ALL SELECT query_id, level, item_id, 1, pos FROM fill JOIN quota USING (level) LEFT JOIN taken USING (query_id, level)
        WHERE pos + coalesce(n, 0) <= quota)
    SELECT query_id, level, item_id, source, row_number() OVER (PARTITION BY query_id, level ORDER BY source, pos) AS place FROM both_parts""")
def learning_path(t: Tables) -> DataFrame:
    """Stages of three, four and three items; gaps come from the category of the best item."""
    level = cat.difficulty(F.lit(""), F.col("description"), {"none": 0}, ["license"], ["que"])
    lv = durable(items(t).select("item_id", "category", level.alias("level"),
                                 F.coalesce(F.get("topics", F.lit(0)), F.lit("")).alias("topic")))
    ranked = durable(search.top_n(search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score"), 8))
    lead = ranked.filter("rank = 1").join(lv.select("item_id", "category"), "item_id").select("query_id", "category")
    # A stage needs at most four fillers beside the eight ranked items, one per
    # topic first: the head of each (category, level, topic) and of each level is enough.
    heads = top_per_group(lv, ["category", "level", "topic"], [F.col("item_id")], 12).drop("rank")
    pool = lead.join(heads, "category").select("query_id", "item_id", "level", F.lit(0).alias("matches"), "topic")
    out = an.learning_path(ranked, lv.select("item_id", "level"), pool, {0: 3, 1: 4, 2: 3})
    return out.select("query_id", "level", "item_id", "source", F.col("place").cast("bigint").alias("place"))


@query("p3_stage_resources")
def stage_resources(t: Tables) -> DataFrame:
    """Documents for the stages of a plan: clause by clause search with a word in common."""
    stages = t.benchmark.select("item_id", F.posexplode(F.split("text", r"\.\s+")).alias("stage", "query")).filter(F.trim("query") != "")
    # Stages of one plan are neighbours below the plan's number; 2^20 leaves room for more than any text has.
    asked = stages.select((F.col("item_id") * (1 << 20) + F.col("stage")).alias("query_id"), "item_id", "stage", "query")
    found = search.top_n(search.bm25_scores(items(t), asked, LEXICON).withColumnRenamed("bm25", "score"), 8)
    text = tx.strip_accents(F.concat_ws(" ", "title", F.array_join("topics", " "), "description"))
    c = found.join(asked.withColumnRenamed("item_id", "plan"), "query_id").join(items(t), "item_id").withColumns({
        "_h": text, "_w": F.filter(qt.bare_words(F.col("query")), lambda w: F.length(w) >= 3)})
    kept = c.filter(F.exists("_w", lambda w: F.contains(F.col("_h"), w)))
    out = top_per_group(kept.drop("rank"), ["query_id"], search.by_score(), 3)
    return keep_first(out.select("plan", "stage", "item_id", "rank"), ["plan", "item_id"], [F.col("stage"), F.col("rank")])


# ------------------------------------------------------------ learned ranking

FEATURES = ["tfidf", "bm25", "char", "category_bonus", "topic_jaccard", "topic_contain", "title_overlap", "is_main_type", "n_topics",
            "text_length", "popularity", "title_length"]


@query("k19_ranking_features", f"""WITH {ITEMS_SQL}, {PAIRS_SQL}
    SELECT query_id, item_id, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25, round(cast(cat AS DOUBLE), 6) AS category_bonus, round(jac, 6) AS topic_jaccard,
        round(con, 6) AS topic_contain, round(tit, 6) AS title_overlap, cast(p.type = 'src3' AS DOUBLE) AS is_main_type, cast(len(topics) AS DOUBLE) AS n_topics,
        round(least(length(description) / 500, 2), 6) AS text_length, round(ln(1 + coalesce(pop, 0)), 6) AS popularity, round(least(length(title) / 80, 2), 6) AS title_length
    FROM pairs p JOIN items USING (item_id) LEFT JOIN (SELECT l_partkey AS item_id, count(*) AS pop FROM lineitem GROUP BY 1) USING (item_id)
    WHERE tfidf + bm25 + cat + jac + con + tit > 0""")
def ranking_features(t: Tables) -> DataFrame:
    """Features of every pair that has a signal, the category alone included."""
    out = features(t, heads=None)
    some = sum((F.col(c) for c in ("tfidf", "bm25", "category_bonus", "topic_jaccard", "topic_contain", "title_overlap")), F.lit(0.0)) > 0
    return out.filter(some).select("query_id", "item_id", *[F.round(c, 6).alias(c) for c in FEATURES if c != "char"])


def features(t: Tables, with_char: bool = False, heads: int | None = 1) -> DataFrame:
    """Signals of query-item pairs (``heads`` as in :func:`search.signals`), and measures of the item."""
    pop = t.lineitem.groupBy(F.col("l_partkey").alias("item_id")).agg(F.count(F.lit(1)).alias("_pop"))
    found = search.signals(items(t), queries(t), LEXICON, heads, char=with_char)
    if not with_char:
        found = found.withColumn("char", F.lit(0.0))
    # Measured before the join, so that texts don't travel with the pairs.
    measures = items(t).select("item_id", (F.col("type") == "src3").cast("double").alias("is_main_type"), F.size("topics").cast("double").alias("n_topics"),
                               F.least(F.length("description") / 500, F.lit(2.0)).alias("text_length"), F.least(F.length("title") / 80, F.lit(2.0)).alias("title_length"))
    measures = measures.join(pop, "item_id", "left").withColumn("popularity", F.log1p(F.coalesce("_pop", F.lit(0)))).drop("_pop")
    return found.join(measures, "item_id")


@query("k20_best_unlisted", """
    SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.label <> b.label QUALIFY rank <= 14""")
def best_unlisted(t: Tables, n: int = 14) -> DataFrame:
    """The ``n`` nearest vectors that are not relevant to the query, from one pass over the blocks."""
    own = t.embeddings.groupBy(F.col("vec_id").alias("item_id")).agg(F.collect_set("label").alias("labels"))
    v = vectors(t).join(own, "item_id", "left")
    q = query_vectors(t).join(own.withColumnRenamed("item_id", "query_id"), "query_id", "left")
    return shown(dense.nearest(v, q, n, skip_self=True))


def picked_of_label(t: Tables, n: int, seed: int) -> DataFrame:
    """``n`` seeded relevant vectors per query: each array of a label's ids hands on its first ``n``, found inside the row."""
    v = t.embeddings.select(F.col("vec_id").alias("item_id"), "label").filter("vec_id IS NOT NULL")
    pairs = ev.label_pairs(v, v.withColumnRenamed("item_id", "query_id"))
    drawn = F.transform(F.filter("ids", lambda i: i != F.col("query_id")), lambda i: F.struct(seeded("query_id", i, seed=seed).alias("h"), i.alias("i")))
    rows = pairs.select("query_id", drawn.alias("_all"))
    # Most draws are far from the first; they are sorted only when too few are near.
    limit = (4.0 * n / F.size("_all") - 0.5) * 2.0 ** 64
    some = rows.select("query_id", "_all", F.filter("_all", lambda x: x["h"] <= limit).alias("_some"))
    first = F.slice(F.sort_array(F.when(F.size("_some") >= n, F.col("_some")).otherwise(F.col("_all"))), 1, n)
    found = some.select("query_id", F.explode_outer(first).alias("x")).filter(F.col("x").isNotNull()).select("query_id", F.col("x.h").alias("h"), F.col("x.i").alias("item_id"))
    return top_per_group(found, ["query_id"], [F.col("h"), F.col("item_id")], n).select(
        "query_id", "item_id", F.when(F.col("item_id") % 2 == 0, 2).otherwise(1).alias("grade"))


def hard_negatives(t: Tables, per_query: int = 20, positives: int = 40) -> DataFrame:
    """Relevant vectors up to a bound, the best-scored others, and seeded random ones."""
    picked = durable(picked_of_label(t, positives, 5))
    hard = durable(best_unlisted(t, int(per_query * 0.7)).select("query_id", "item_id"))
    listed = picked.select("query_id", "item_id").unionByName(hard)
    needs = picked.select("query_id").distinct().withColumn("need", F.lit(per_query - int(per_query * 0.7)))
    other = random_unlisted(needs, listed, vectors(t), 6)
    zero = F.lit(0).alias("grade")
    return picked.unionByName(hard.select("*", zero)).unionByName(other.select("*", zero))


@query("k20_hard_negatives")
def hard_negative_sample(t: Tables) -> DataFrame:
    return hard_negatives(t)


@query("k21_graded_pairs", with_entities("event_items") + """
    , judged AS (SELECT user_id, item_id, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS grade
        FROM event_items GROUP BY 1, 2)
    , n AS (SELECT user_id, grade, count(*) AS n FROM judged GROUP BY 1, 2)
    SELECT a.grade AS higher, b.grade AS lower, cast(sum(a.n * least(4, b.n)) AS BIGINT) AS n FROM n a JOIN n b ON a.user_id = b.user_id AND a.grade > b.grade
    GROUP BY 1, 2""")
def graded_pairs(t: Tables) -> DataFrame:
    """Training pairs by grade: what a user bought over what they clicked over what they saw, four of each lower grade or all if fewer."""
    grade = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    rows = event_items(t).groupBy(F.col("user_id").alias("query_id"), "item_id").agg(F.max(grade).alias("grade"))
    pairs = learn.graded_pairs(durable(rows.withColumn("f", F.array(F.lit(1.0)))))
    return pairs.groupBy(F.col("grade").alias("higher"), "lower").agg(F.count(F.lit(1)).alias("n"))


@query("k21_learned_ranker")
def learned_ranker(t: Tables) -> DataFrame:
    """Pairwise ranker on held-out queries against the plain score, with a paired test."""
    from larkfield.plans.evaluation import qrels
    labels = durable(qrels(t))
    found = durable(features(t, with_char=True).select("query_id", "item_id", *FEATURES))
    rows = durable(found.join(labels, ["query_id", "item_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
                   .withColumn("held", F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(4)) == 0), found)
    # Topic matches define the labels, so they are left out of the features.
    use = [c for c in FEATURES if not c.startswith("topic_")]
    model = learn.pairwise_ranker(rows.filter("NOT held"), use)
    test = learn.rank_score(model, rows.filter("held"))
    base = rows.filter("held").withColumn("score", F.col("tfidf") + F.col("bm25"))
    judged = labels.join(test.select("query_id").distinct(), "query_id", "left_semi")
    a, b = (ev.query_metrics(search.top_n(x.select("query_id", "item_id", "score"), 100), judged, (10,)) for x in (test, base))
    return ev.compare(durable(ev.paired(a, b, "ndcg_10")), draws=200)


@query("b14_filled_blanks", """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE o_orderpriority END AS priority FROM orders""")
def filled_blanks(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return clean.fill_blanks(rows, {"priority": "unknown"}, ["nan", "none", "4-NOT SPECIFIED"])


@query("h1_5_clean_lists", """
    SELECT doc_id, lang || ', ' || source AS topics, source AS owner FROM documents""")
def clean_lists(t: Tables) -> DataFrame:
    """List literals, pipes and semicolons all become comma lists."""
    literal = F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']"))
    raw = F.when(F.col("lang") == "en", literal).when(F.col("lang") == "de", F.concat_ws("|", "lang", "source")).otherwise(
        F.concat_ws(" ; ", "lang", "source"))
    return t.documents.select("doc_id", tx.clean_topics(raw).alias("topics"),
                              tx.unwrap_list(F.concat(F.lit("['"), "source", F.lit("']"))).alias("owner"))
