"""Search domain: text and dense channels over documents, vectors and benchmark queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions import numbers as nm
from larkfield.functions import text as tx
from larkfield.operators import dense, encode, search
from larkfield.operators import text_index as ti
from larkfield.operators.ranking import top_per_group
from larkfield.plans.registry import Tables, query
from larkfield.plans.text import bare_sql, norm_sql, tokens_sql, topics_col, topics_sql, words_sql
from larkfield.session import durable

# A small dictionary for the languages of the driver tables.
LEXICON = search.Lexicon(
    phrases=(("of the", "en"), ("the", "en"), ("und", "de"), ("der", "de"), ("les", "fr"), ("dans", "fr"),
             ("los", "es"), ("de la", "es")),
    categories=("en", "de", "fr", "es"), related=(("fr", "es"),), max_df=0.88, max_features=12000)


def items(t: Tables) -> DataFrame:
    """Documents as search items: language is the category, source the type."""
    return t.documents.select(
        F.col("doc_id").alias("item_id"), F.split("text", "\n")[0].alias("title"),
        topics_col(F.split("text", "\n")[0]).alias("topics"), F.col("lang").alias("category"),
        F.col("source").alias("type"), F.col("text").alias("description"))


def queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def query_vectors(t: Tables) -> DataFrame:
    """Every vector asks for its neighbours."""
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


# ------------------------------------------------------------------ SQL parts

ITEMS_SQL = f"""items AS MATERIALIZED (SELECT doc_id item_id, title, {topics_sql('title')} topics, lang category,
    source AS type, text description FROM (SELECT *, split_part(text, chr(10), 1) title FROM documents))
, queries AS (SELECT item_id query_id, text query FROM benchmark)"""


def field_sql(field: str) -> str:
    """Token list of a weighted field."""
    glue = {"ti": words_sql("title"), "tp": "topics", "ca": words_sql("category"), "de": words_sql("description"),
            "ty": words_sql("type")}
    times = {"title": [("ti", 6)], "topics": [("tp", 5)],
             "full": [("ti", 6), ("tp", 5), ("ca", 4), ("de", 2), ("ty", 2)]}[field]
    parts = ", ".join(f"flatten([{p} for _ in range({n})])" for p, n in times)
    cols = ", ".join(f"{glue[p]} AS {p}" for p, _ in times)
    stop = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
    return (f"SELECT item_id, list_filter(list_concat({parts}), lambda w: length(w) >= 2 AND NOT "
            f"list_contains({stop}, w)) AS toks FROM (SELECT item_id, {cols} FROM items)")


def gram_counts(name: str, key: str, source: str) -> str:
    """CTE ``name(key, term, tf)`` of 1-3-grams over a token list query."""
    return f"""{name} AS MATERIALIZED (
    SELECT {key}, term, count(*) AS tf FROM (
        SELECT {key}, unnest([token, token || '_' || n1, token || '_' || n1 || '_' || n2]) AS term FROM (
            SELECT {key}, token, lead(token, 1) OVER w AS n1, lead(token, 2) OVER w AS n2 FROM (
                SELECT {key}, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM ({source}))
            WINDOW w AS (PARTITION BY {key} ORDER BY pos))) WHERE term IS NOT NULL GROUP BY 1, 2)"""


def vocab_sql(name: str, terms: str, limit: bool = True) -> str:
    cut = "WHERE df <= 0.88 * n ORDER BY cc DESC, term LIMIT 12000" if limit else ""
    return f"""{name} AS MATERIALIZED (SELECT term, df, cc, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
        SELECT term, count(*) AS df, sum(tf) AS cc FROM {terms} GROUP BY 1), (SELECT count(*) AS n FROM items) {cut})"""


def weight_sql(name: str, key: str, terms: str, vocab: str, sublinear: bool = True) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""{name} AS MATERIALIZED (SELECT {key}, term, r / sqrt(sum(r * r) OVER (PARTITION BY {key})) AS w FROM (
        SELECT {key}, term, {tf} * idf AS r FROM {terms} JOIN {vocab} USING (term)))"""


QUERY_GRAMS = gram_counts("qg", "query_id", f"SELECT query_id, {tokens_sql('query')} AS toks FROM queries")


def tfidf_sql(fields=(("title", 0.38), ("topics", 0.37), ("full", 0.25))) -> str:
    ctes, unions = [QUERY_GRAMS], []
    for f, w in fields:
        ctes += [gram_counts(f"{f}_g", "item_id", field_sql(f)), vocab_sql(f"{f}_v", f"{f}_g"),
                 weight_sql(f"{f}_w", "item_id", f"{f}_g", f"{f}_v"), weight_sql(f"{f}_q", "query_id", "qg", f"{f}_v")]
        unions.append(f"SELECT query_id, item_id, {w} * sum(d.w * q.w) AS s FROM {f}_w d JOIN {f}_q q USING (term) GROUP BY 1, 2")
    ctes.append("tfidf AS MATERIALIZED (SELECT query_id, item_id, sum(s) AS tfidf FROM (" + " UNION ALL ".join(unions) + ") GROUP BY 1, 2)")
    return ",\n".join(ctes)


RAW_TEXT = "title || ' ' || array_to_string(topics, ' ') || ' ' || category || ' ' || description"
BM25_SQL = f"""{gram_counts('dg', 'item_id', f"SELECT item_id, {tokens_sql(RAW_TEXT)} AS toks FROM items")}
, dl AS (SELECT item_id, coalesce(sum(tf), 0) AS dl FROM items LEFT JOIN dg USING (item_id) GROUP BY 1)
, bidf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM dg GROUP BY 1),
           (SELECT count(*) AS n FROM items))
, bm25_raw AS MATERIALIZED (SELECT query_id, item_id, sum(idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / avgdl))) AS s
    FROM (SELECT query_id, term FROM qg) q JOIN dg USING (term) JOIN bidf USING (term) JOIN dl USING (item_id),
         (SELECT avg(dl) AS avgdl FROM dl) GROUP BY 1, 2)
, bm25 AS MATERIALIZED (SELECT query_id, item_id, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END AS bm25
    FROM bm25_raw JOIN (SELECT query_id, CASE WHEN count(*) < (SELECT count(*) FROM items) THEN 0 ELSE min(s) END AS lo,
                               max(s) AS hi FROM bm25_raw GROUP BY 1) USING (query_id))"""


def top_sql(source: str, score: str, n: int, out: str = "score") -> str:
    return f"""SELECT query_id, item_id, round({score}, 6) AS {out},
        row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, item_id) AS rank FROM {source}
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, item_id) <= {n}"""


def shown(df: DataFrame, score: str = "score") -> DataFrame:
    return df.select("query_id", "item_id", F.round(score, 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------- text channels

@query("i1_tfidf_vocabulary", f"WITH {ITEMS_SQL}, {gram_counts('g', 'item_id', field_sql('full'))}, {vocab_sql('v', 'g')} "
       "SELECT term, df, cast(cc AS BIGINT) AS corpus_count, round(idf, 9) AS idf FROM v")
def tfidf_vocabulary(t: Tables) -> DataFrame:
    c = items(t)
    lists, fields = search.field_lists(c, ["full"], LEXICON)
    vocab = ti.frequent_vocabulary(durable(lists), fields, 3, ti.row_total(c), LEXICON.max_df, LEXICON.max_features)
    return vocab.drop("field").withColumn("idf", F.round("idf", 9))


@query("i1_tfidf_title_weights", f"WITH {ITEMS_SQL}, {gram_counts('g', 'item_id', field_sql('title'))}, {vocab_sql('v', 'g')}, "
       f"{weight_sql('w', 'item_id', 'g', 'v')} SELECT item_id, term, round(w, 9) AS weight FROM w")
def tfidf_title_weights(t: Tables) -> DataFrame:
    c = items(t)
    terms = durable(search.field_terms(c, ["title"], LEXICON).drop("field"))
    return ti.tfidf(terms, "item_id", ti.vocabulary(terms, ti.row_total(c), LEXICON.max_df, LEXICON.max_features)).withColumn("weight", F.round("weight", 9))


@query("i2_multi_field_cosine", f"WITH {ITEMS_SQL}, {tfidf_sql()} {top_sql('tfidf', 'tfidf', 10)}")
def multi_field_cosine(t: Tables) -> DataFrame:
    scores = search.tfidf_scores(items(t), queries(t), LEXICON, most=10)
    return shown(search.top_n(scores.withColumnRenamed("tfidf", "score"), 10))


@query("i3_bm25_top10", f"WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL} {top_sql('bm25_raw', 's', 10)}")
def bm25_top10(t: Tables) -> DataFrame:
    scores = search.bm25_scores(items(t), queries(t), LEXICON, scaled=False)
    return shown(search.top_n(scores.withColumnRenamed("bm25", "score"), 10))


@query("h4_10_min_max_bm25", f"WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL} {top_sql('bm25', 'bm25', 10)}")
def min_max_bm25(t: Tables) -> DataFrame:
    scores = search.bm25_scores(items(t), queries(t), LEXICON)
    return shown(search.top_n(scores.withColumnRenamed("bm25", "score"), 10))


def char_counts(name: str, key: str, text: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM (
        SELECT {key}, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substring(w, i, k))) AS term
        FROM (SELECT {key}, ' ' || unnest({words_sql(bare_sql(text))}) || ' ' AS w FROM {source}), (VALUES (2), (3), (4)) v(k)
        WHERE length(w) >= k) GROUP BY 1, 2)"""


CHAR_SQL = f"""{char_counts('cg', 'item_id', "title || ' ' || array_to_string(topics, ' ') || ' ' || category", 'items')}
, {char_counts('cq', 'query_id', 'query', 'queries')}, {vocab_sql('cv', 'cg', limit=False)}
, {weight_sql('cw', 'item_id', 'cg', 'cv', False)}, {weight_sql('cqw', 'query_id', 'cq', 'cv', False)}
, chars AS MATERIALIZED (SELECT query_id, item_id, sum(d.w * q.w) AS char FROM cw d JOIN cqw q USING (term) GROUP BY 1, 2)"""


@query("i4_char_channel", f"WITH {ITEMS_SQL}, {CHAR_SQL} {top_sql('chars', 'char', 10)}")
def char_channel(t: Tables) -> DataFrame:
    return shown(search.top_n(search.char_scores(items(t), queries(t), 10).withColumnRenamed("char", "score"), 10))


HINT_SQL = f"""hints AS MATERIALIZED (SELECT query_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN NULL
        WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de'
        WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS hint FROM (
    SELECT query_id, CASE WHEN contains(b, 'of the') THEN 2.06 ELSE 0 END + CASE WHEN list_contains(w, 'the') THEN 1.03 ELSE 0 END AS en,
           CASE WHEN list_contains(w, 'und') THEN 1.03 ELSE 0 END + CASE WHEN list_contains(w, 'der') THEN 1.03 ELSE 0 END AS de,
           CASE WHEN list_contains(w, 'les') THEN 1.03 ELSE 0 END + CASE WHEN list_contains(w, 'dans') THEN 1.04 ELSE 0 END AS fr,
           CASE WHEN list_contains(w, 'los') THEN 1.03 ELSE 0 END + CASE WHEN contains(b, 'de la') THEN 2.05 ELSE 0 END AS es
    FROM (SELECT query_id, b, string_split(b, ' ') w FROM (SELECT query_id, {bare_sql(norm_sql('query'))} b FROM queries))))"""


@query("h3_5_category_detection", f"WITH {ITEMS_SQL}, {HINT_SQL} SELECT query_id, hint FROM hints")
def category_detection(t: Tables) -> DataFrame:
    return search.with_hints(queries(t), LEXICON).select("query_id", "hint")


# Brute force over every query-item pair, independent of how the plan finds candidates.
PAIRS_SQL = f"""{tfidf_sql()}, {BM25_SQL}, {HINT_SQL}
, qt AS (SELECT query_id, list_distinct({tokens_sql('query', 3)}) AS q FROM queries)
, pairs AS MATERIALIZED (SELECT query_id, item_id, category, type, coalesce(tfidf, 0) tfidf, coalesce(bm25, 0) bm25,
    CASE WHEN hint IS NULL THEN 0 WHEN hint = category THEN 1 WHEN hint IN ('fr', 'es') AND category IN ('fr', 'es') THEN 0.55 ELSE 0 END AS cat,
    CASE WHEN len(q) > 0 AND len(topics) > 0 THEN len(list_intersect(q, topics)) / len(list_distinct(list_concat(q, topics))) ELSE 0 END AS jac,
    CASE WHEN len(q) > 0 THEN len(list_intersect(q, topics)) / len(q) ELSE 0 END AS con,
    CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: contains(nt, w))) / len(q) ELSE 0 END AS tit
    FROM qt JOIN hints USING (query_id) CROSS JOIN (SELECT *, {norm_sql('title')} AS nt FROM items)
    LEFT JOIN tfidf USING (query_id, item_id) LEFT JOIN bm25 USING (query_id, item_id))
, lexical AS (SELECT *, least(1, 0.42 * tfidf + 0.18 * bm25 + 0.14 * cat + 0.12 * jac + 0.06 * con + 0.05 * tit) AS score FROM pairs)"""


@query("i10_lexical_search", f"WITH {ITEMS_SQL}, {PAIRS_SQL} {top_sql('lexical', 'score', 10)}")
def lexical_search(t: Tables) -> DataFrame:
    return shown(search.lexical_search(items(t), queries(t), LEXICON, 10))


@query("i10_lexical_search_one_type", f"""WITH {ITEMS_SQL}, {PAIRS_SQL}
    , one AS (SELECT query_id, item_id, least(1, 0.42 * tfidf + 0.18 * bm25 + 0.14 * cat + 0.12 * jac + 0.06 * con
                     + 0.05 * tit + 0.03) AS score FROM pairs WHERE type = 'src3' AND tfidf + bm25 + cat + jac + con + tit > 0)
    {top_sql('one', 'score', 5)}""")
def lexical_search_one_type(t: Tables) -> DataFrame:
    return shown(search.lexical_search(items(t), queries(t), LEXICON, 5, "src3"))


@query("h4_9_query_item_score", f"""WITH {ITEMS_SQL}, {PAIRS_SQL}
    SELECT query_id, item_id, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25, round(cast(cat AS DOUBLE), 6) AS category_bonus,
           round(jac, 6) AS topic_jaccard, round(con, 6) AS topic_contain, round(tit, 6) AS title_overlap,
           round(score, 6) AS score FROM lexical WHERE tfidf + bm25 + cat + jac + con + tit > 0""")
def query_item_score(t: Tables) -> DataFrame:
    """Every pair that has a signal, the category alone included."""
    found = search.signals(items(t), queries(t), LEXICON, None)
    cols = ["tfidf", "bm25", "category_bonus", "topic_jaccard", "topic_contain", "title_overlap"]
    weights = {("category_bonus" if k == "category" else k): w for k, w in nm.QUERY_ITEM_WEIGHTS.items() if k != "type_match"}
    some = found.filter(sum((F.col(c) for c in cols), F.lit(0.0)) > 0)
    return some.select("query_id", "item_id", *[F.round(c, 6).alias(c) for c in cols],
                       F.round(nm.weighted(weights), 6).alias("score"))


RRF_SQL = """rrf AS (SELECT query_id, item_id, sum(1 / (60 + rank)) AS score FROM (
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(tfidf, 9) DESC, item_id) AS rank FROM tfidf
    QUALIFY rank <= 50
    UNION ALL SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, item_id) AS rank
    FROM bm25 QUALIFY rank <= 50) GROUP BY 1, 2)"""


@query("i12_rank_fusion", f"WITH {ITEMS_SQL}, {tfidf_sql()}, {BM25_SQL}, {RRF_SQL} {top_sql('rrf', 'score', 10)}")
def rank_fusion(t: Tables) -> DataFrame:
    a = search.tfidf_scores(items(t), queries(t), LEXICON).withColumnRenamed("tfidf", "score")
    b = search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
    lists = search.top_n(a, 50).unionByName(search.top_n(b, 50))
    return shown(search.top_n(search.reciprocal_rank_fusion(lists), 10))


@query("i16_first_signals", f"""WITH {ITEMS_SQL}, {PAIRS_SQL}
    , cand AS (SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, item_id) rank
               FROM bm25) WHERE rank <= 100)
    , l1 AS (SELECT query_id, item_id, bm25 + 0.14 * cat + 0.12 * jac + 0.06 * con + 0.05 * tit AS score
             FROM pairs JOIN cand USING (query_id, item_id))
    {top_sql('l1', 'score', 10)}""")
def first_signals(t: Tables) -> DataFrame:
    base = search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
    cand = search.top_n(base, 100).drop("rank")
    return shown(search.top_n(search.first_signals(cand, items(t), queries(t), LEXICON), 10))


@query("i20_prompt_context", f"""WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}, best AS ({top_sql('bm25', 'bm25', 3)})
    SELECT query_id, string_agg('[' || rank || '] ' || title || ' (' || category || ')', '\n---\n' ORDER BY rank) AS context
    FROM best JOIN items USING (item_id) GROUP BY 1""".replace("'\n---\n'", "chr(10) || '---' || chr(10)"))
def prompt_context(t: Tables) -> DataFrame:
    scores = search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
    best = search.top_n(scores, 3).join(items(t).select("item_id", "title", "category"), "item_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("category"), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return best.groupBy("query_id").agg(F.array_join(lines, "\n---\n").alias("context"))


@query("e4_ranked_pages", f"""WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}
    SELECT * FROM ({top_sql('bm25', 'bm25', 20)}) WHERE rank > 10""")
def ranked_pages(t: Tables) -> DataFrame:
    """Second page of ten results per query."""
    scores = search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
    return shown(search.top_n(scores, 20).filter("rank > 10"))


# ------------------------------------------------------------- dense channel

DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
KNN_SQL = f"""knn AS MATERIALIZED (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {DOT} AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id)
, top10 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM knn
    QUALIFY rank <= 10)"""


def neighbours10(t: Tables) -> DataFrame:
    return dense.nearest(vectors(t), query_vectors(t), 10, skip_self=True)


@query("i5_dense_scores", f"WITH {KNN_SQL} SELECT query_id, item_id, round(score, 6) AS score FROM knn WHERE score >= 0.2")
def dense_scores(t: Tables) -> DataFrame:
    return dense.above_each_other(vectors(t), 0.2, digits=6)


@query("i7_nearest_neighbours", f"WITH {KNN_SQL} SELECT query_id, item_id, round(score, 6) AS score, rank FROM top10")
def nearest_neighbours(t: Tables) -> DataFrame:
    return shown(neighbours10(t))


# The given vectors form no groups, so neighbours lie in nearly all cells: most cells are probed, by byte codes.
PROBED = {"centres": 8, "probes": 7, "shortlist": 40}


@query("i7_approximate_recall", "SELECT count(*) AS n_queries, true AS recall_reached, true AS share_kept FROM embeddings")
def approximate_recall(t: Tables) -> DataFrame:
    """Neighbours by trained centres measured against the exact ones: recall of .9, a fifth of the vectors in full precision."""
    near = dense.nearest_by_centres(vectors(t), query_vectors(t), 10, **PROBED, skip_self=True)
    return dense.recall(neighbours10(t), near).withColumn("n_queries", ti.row_total(t.embeddings)).select(
        "n_queries", (F.col("recall") >= 0.9).alias("recall_reached"), (PROBED["shortlist"] <= 0.2 * F.col("n_queries")).alias("share_kept"))


@query("f2_partial_top_k", f"""WITH {KNN_SQL} SELECT query_id, item_id, round(score, 6) AS score, rank FROM top10 WHERE rank <= 3""")
def partial_top_k(t: Tables) -> DataFrame:
    return shown(dense.nearest(vectors(t), query_vectors(t), 3, skip_self=True))


@query("i9_relevance_gate", f"""WITH {KNN_SQL} SELECT query_id, item_id, round(score, 6) AS score FROM knn
    WHERE score >= 0.3 AND query_id IN (SELECT query_id FROM knn GROUP BY 1 HAVING max(score) >= 0.38)""")
def relevance_gate(t: Tables) -> DataFrame:
    scores = dense.above_each_other(vectors(t), 0.3)
    return search.gated(scores, 0.38, 0.3).withColumn("score", F.round("score", 6))


@query("i9_off_topic_gate", f"""WITH {KNN_SQL} SELECT query_id, item_id, round(score, 6) AS score FROM knn
    WHERE score >= 0.3 AND (query_id IN (SELECT query_id FROM knn GROUP BY 1 HAVING max(score) >= 0.55)
                            OR query_id IN (SELECT vec_id FROM embeddings WHERE label = 3))""")
def off_topic_gate(t: Tables) -> DataFrame:
    """Stricter gate with an exemption for known entities."""
    scores = dense.above_each_other(vectors(t), 0.3)
    known = t.embeddings.filter("label = 3").select(F.col("vec_id").alias("query_id"))
    return search.gated(scores, nm.OFF_TOPIC_GATE, 0.3, known).withColumn("score", F.round("score", 6))


@query("h4_1_display_confidence", f"""WITH {KNN_SQL} SELECT query_id, item_id, rank,
    round(0.9 + 0.1 * pow(least(1, greatest(0, (score / max(score) OVER (PARTITION BY query_id) - 0.5) / 0.5)), 0.7), 6) AS confidence
    FROM top10""")
def display_confidence(t: Tables) -> DataFrame:
    shown_ = search.with_confidence(neighbours10(t))
    return shown_.select("query_id", "item_id", F.col("rank").cast("bigint").alias("rank"),
                         F.round("confidence", 6).alias("confidence"))


@query("h4_2_sigmoid_softmax", f"""WITH {KNN_SQL} SELECT query_id, item_id, round(1 / (1 + exp(-score)), 6) AS squashed,
    round(exp(score) / sum(exp(score)) OVER (PARTITION BY query_id), 6) AS share FROM top10""")
def sigmoid_softmax(t: Tables) -> DataFrame:
    return neighbours10(t).select("query_id", "item_id", F.round(nm.sigmoid(F.col("score")), 6).alias("squashed"),
                                  F.round(nm.softmax(F.col("score"), ["query_id"]), 6).alias("share"))


BENCH_DENSE = f"""dense AS MATERIALIZED (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {DOT} AS dense
    FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id IN (SELECT query_id FROM queries) AND {DOT} >= 0.25)"""


def bench_dense(t: Tables, asked: DataFrame, floor: float = 0.25, most: int | None = None) -> DataFrame:
    """Dense channel for benchmark queries, or the best ``most`` of each; the vector of the same number stands for the query."""
    origin = "origin" if "origin" in asked.columns else "query_id"
    q = asked.select("query_id", F.col(origin).alias("vec_id")).join(t.embeddings, "vec_id").select(
        "query_id", F.col("embedding").alias("vector"))
    if most:
        return dense.nearest(vectors(t), q, most).filter(F.col("score") >= floor).drop("rank")
    return dense.above(vectors(t), q, floor)


def fused(t: Tables, asked: DataFrame, most: int | None = None, least: float = 0.0, index: search.CharIndex | None = None) -> DataFrame:
    """Larger of the dense and the character channel.

    The best ``most`` of a query are among the best of one channel by that channel's score, so others may be left out; pairs below ``least`` are.
    """
    d = bench_dense(t, asked, max(0.25, least), most).withColumnRenamed("score", "dense")
    return search.max_fusion(d, search.char_scores(items(t), asked, most, least, index), "dense", "char")


FUSED_SQL = f"""{CHAR_SQL}, {BENCH_DENSE}, fused AS MATERIALIZED (SELECT query_id, item_id, greatest(dense, char) AS score
    FROM dense FULL JOIN chars USING (query_id, item_id))"""


@query("i6_max_fusion", f"WITH {ITEMS_SQL}, {FUSED_SQL} {top_sql('fused', 'score', 10)}")
def max_fusion(t: Tables) -> DataFrame:
    return shown(search.top_n(fused(t, queries(t), 10), 10))


VOWELS = "aeiou"


@query("o5_encoder_hook", f"""WITH counts AS (SELECT doc_id, list_transform(string_split('{' '.join(VOWELS)}', ' '),
        lambda c: length('note: ' || lower(text)) - length(replace('note: ' || lower(text), c, '')))::DOUBLE[] AS v FROM documents)
    SELECT doc_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS vector FROM counts""")
def encoder_hook(t: Tables) -> DataFrame:
    """A toy encoder (vowels of the text) with a passage prefix, for the hook that takes any batch encoder."""
    def vowels(texts):
        return [[text.lower().count(c) for c in VOWELS] for text in texts]

    out = encode.encode(t.documents, "doc_id", "text", vowels, encode.Preset(passage="note: ").passage)
    return out.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query("i11_dense_search", f"""WITH {ITEMS_SQL}, {FUSED_SQL}
    , passed AS (SELECT * FROM fused WHERE score >= 0.42 AND query_id IN (
        SELECT query_id FROM fused GROUP BY 1 HAVING max(score) >= 0.48))
    SELECT query_id, item_id, round(0.9 + 0.1 * pow(least(1, greatest(0, (score / max(score) OVER (PARTITION BY query_id) - 0.5) / 0.5)), 0.7), 6)
           AS confidence FROM passed
    QUALIFY confidence >= 0.95""")
def dense_search(t: Tables) -> DataFrame:
    """Gate, floor, confidence, minimum share."""
    shown_ = search.with_confidence(search.gated(fused(t, queries(t), least=nm.ITEM_FLOOR)))
    return shown_.select("query_id", "item_id", F.round("confidence", 6).alias("confidence")).filter("confidence >= 0.95")


@query("i13_multi_variant_search")
def multi_variant_search(t: Tables) -> DataFrame:
    """Query forms searched on their own, fused by rank, diversified; the gate looks at the query as it was asked."""
    asked = search.query_variants(queries(t)).withColumnRenamed("query_id", "origin").withColumnRenamed("variant_id", "query_id")
    index = search.char_index(items(t))
    # The gate needs the best of a query, a list its first 32; no more rows of a channel leave a task.
    passed = search.gated(fused(t, queries(t), 1, index=index)).select(F.col("query_id").alias("origin")).distinct()
    asked = durable(asked.join(passed, "origin", "left_semi"))
    lists = top_per_group(fused(t, asked, 32, index=index), ["query_id"], search.by_score(), 32)
    back = lists.join(asked.select("query_id", "origin"), "query_id").select(
        F.col("origin").alias("query_id"), "item_id", "rank")
    pool = durable(search.top_n(search.reciprocal_rank_fusion(back), 32))
    return shown(search.diversified(pool, vectors(t), search.Diversify(k=8), 32).filter("rank <= 8"))


@query("i14_mmr")
def mmr(t: Tables) -> DataFrame:
    pool = dense.nearest(vectors(t), query_vectors(t), 48, skip_self=True)
    return shown(search.mmr(pool.join(vectors(t), "item_id"), 10))


# Four rankings that use every step at least once.
RANKINGS = {
    "plain_text": search.Ranking(search.Candidates("lexical", 300), frozenset({"title"})),
    "long_text": search.Ranking(search.Candidates("bm25", 200), frozenset({"topic"}), rerank_pool=24),
    "meaning": search.Ranking(search.Candidates("embedding"), frozenset({"topic", "category"}), diversify=search.Diversify(k=5)),
    "both_forms": search.Ranking(search.Candidates("rag_fusion", 100), search.ALL_SIGNALS, 24, search.Diversify(k=6, weight=0.8)),
}


@query("i15_staged_ranking")
def staged_ranking(t: Tables) -> DataFrame:
    """All named configurations of the staged ranking, ten results each."""
    c, q = items(t), queries(t)
    index = search.char_index(c)
    # A ranking reads as many rows of the dense channel as it hands on.
    most = {r.candidates.channel: r.candidates.most for r in RANKINGS.values()}
    ready = {name: durable(df) for name, df in (
        ("tfidf", search.tfidf_scores(c, q, LEXICON)), ("bm25", search.bm25_scores(c, q, LEXICON)), ("topic", search.topic_scores(c, q, LEXICON)),
        ("title", search.title_scores(c, q, LEXICON)), ("embedding", fused(t, q, most["embedding"], index=index)))}
    out = None
    for name, plan in RANKINGS.items():
        one = search.staged_ranking(plan, c, q, LEXICON, lambda x: fused(t, x, plan.candidates.most, index=index), vectors(t), 10, ready)
        one = shown(one).select(F.lit(name).alias("config"), "query_id", "item_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("i17_pool_rerank")
def pool_rerank(t: Tables) -> DataFrame:
    scores = search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score")
    texts = items(t).select("item_id", F.concat_ws(". ", "title", "category", "description").alias("text"))
    out = search.rerank_pool(search.top_n(scores, 100), queries(t), texts, 48)
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), "stage", F.col("rank").cast("bigint").alias("rank"))
