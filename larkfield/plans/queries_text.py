"""Message domain: spelling, entities, intents, context and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.operators import query_text as qt
from larkfield.operators import search
from larkfield.operators import skills as sk
from larkfield.operators.ranking import group_positions
from larkfield.plans.registry import Tables, query
from larkfield.plans.search import BM25_SQL, ITEMS_SQL, LEXICON, QUERY_GRAMS, items, queries, top_sql
from larkfield.plans.text import bare_sql, norm_sql, tokens_sql, words_sql

BARE_WORDS = words_sql(bare_sql("text"))


def _word_counts(t: Tables) -> DataFrame:
    return (t.documents.select(F.explode(qt.bare_words(F.col("text"))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("h3_1_corrections", f"""
    WITH vocab AS (SELECT word FROM (SELECT unnest({BARE_WORDS}) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 20)
    , asked AS (SELECT DISTINCT word FROM (SELECT unnest({BARE_WORDS}) AS word FROM benchmark)
                WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM vocab))
    SELECT a.word, v.word AS fixed, round(1 - levenshtein(a.word, v.word) / greatest(length(a.word), length(v.word)), 6) AS similarity
    FROM asked a JOIN vocab v ON round(1 - levenshtein(a.word, v.word) / greatest(length(a.word), length(v.word)), 6) >= 0.84
    QUALIFY row_number() OVER (PARTITION BY a.word ORDER BY similarity DESC, v.word) = 1""")
def corrections(t: Tables) -> DataFrame:
    """Unknown query words against the frequent words of the documents."""
    vocab = _word_counts(t).filter("n >= 20").select("word")
    asked = t.benchmark.select(F.explode(qt.bare_words(F.col("text"))).alias("word"))
    return qt.corrections(asked, vocab).select("word", "fixed", "similarity")


SHORT_FORMS = {"et": "and so on", "of": "belonging to", "der": "article masculine"}


@query("h3_2_abbreviations", f"""
    SELECT conv_id, turn, concat_ws(' ', n, CASE WHEN list_contains(w, 'et') THEN 'and so on' END,
           CASE WHEN list_contains(w, 'of') AND len(w) = 1 THEN 'belonging to' END,
           CASE WHEN list_contains(w, 'der') THEN 'article masculine' END) AS expanded
    FROM (SELECT conv_id, turn, {norm_sql('text')} AS n, {words_sql('text')} AS w FROM conversations)""")
def abbreviations(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", qt.expand_abbreviations(F.col("text"), SHORT_FORMS, ["of"]).alias("expanded"))


@query("h3_3_vocabulary", f"""
    SELECT DISTINCT word FROM (SELECT unnest(list_concat({words_sql(bare_sql('source'))}, {words_sql(bare_sql('lang'))}, {BARE_WORDS})) AS word
    FROM documents) WHERE length(word) >= 3 AND regexp_matches(word, '^\\pL+$')""")
def vocabulary(t: Tables) -> DataFrame:
    return qt.vocabulary_of(t.documents, [F.col("source"), F.col("lang"), F.col("text")])


@query("h3_4_expanded_queries", f"""
    SELECT conv_id, turn, concat_ws(' ', text, CASE WHEN list_contains(w, 'les') THEN 'plural article' END,
        CASE WHEN contains(n, 'enti') OR list_contains(w, 'enti') THEN 'enti' END,
        CASE WHEN contains(n, 'that thing') OR list_contains(w, 'that') OR list_contains(w, 'thing') THEN 'That Thing' END,
        nullif(k, ''), nullif(k, '')) AS expanded
    FROM (SELECT *, {norm_sql('text')} AS n, {words_sql('text')} AS w, array_to_string({tokens_sql('text', 3)}, ' ') AS k FROM conversations)""")
def expanded_queries(t: Tables) -> DataFrame:
    out = qt.expand_query(F.col("text"), {"les": "plural article"}, ["enti", "That Thing"], tx.STOP_WORDS)
    return t.conversations.select("conv_id", "turn", out.alias("expanded"))


ENTITIES = {"english": ["the", "that", "of the"], "german": ["und", "der", "die"], "french": ["les", "dans", "de la"], "short": ["en", "a"]}


def _best_sql(options: list[str]) -> str:
    hits = []
    for a in options:
        cond = f"contains(b, '{a}')" if " " in a else f"list_contains(w, '{a}') AND ({len(a) >= 3} OR len(w) = 1)"
        hits.append(f"CASE WHEN {cond} THEN {len(a)} ELSE 0 END")
    return f"greatest({', '.join(hits)})"


@query("h3_6_entities", f"""
    WITH c AS (SELECT conv_id, turn, b, string_split(b, ' ') AS w FROM (SELECT conv_id, turn, {bare_sql(norm_sql('text'))} AS b FROM conversations))
    , s AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{n}' AS name, {i} AS ord, {_best_sql(o)} AS best FROM c" for i, (n, o) in enumerate(ENTITIES.items()))})
    SELECT conv_id, turn, coalesce(string_agg(name, ',' ORDER BY best DESC, ord) FILTER (best > 0), '') AS entities FROM s GROUP BY 1, 2""")
def entities(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(qt.match_entities(F.col("text"), ENTITIES), ",").alias("entities"))


INTENTS = (("definition", r"\bwhat is\b|\bqui\b"), ("comparison", r"\bvs\b|\bund\b"), ("path", r"\bthe .* of\b"), ("search", r"\bde\b"))


def _intent_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in INTENTS)
    return f"CASE {cases} END"


@query("h3_7_intents", f"""
    SELECT conv_id, turn, {_intent_sql('b')} AS intent FROM (SELECT conv_id, turn, {bare_sql(norm_sql('text'))} AS b FROM conversations)""")
def intents(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", qt.first_rule(F.col("text"), INTENTS).alias("intent"))


@query("h3_8_modes_and_flags", f"""
    SELECT conv_id, turn, CASE WHEN regexp_matches(b, '\\bles\\b|\\blos\\b') THEN 'plural' ELSE 'single' END AS mode,
           length(text) < 60 AS is_short, contains(text, '?') AS is_question,
           CASE WHEN regexp_matches(b, '\\bfree|gratis') THEN true ELSE false END AS wants_free
    FROM (SELECT *, {bare_sql(norm_sql('text'))} AS b FROM conversations)""")
def modes_and_flags(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.conversations.select(
        "conv_id", "turn", qt.first_rule(text, [("plural", r"\bles\b|\blos\b")], "single").alias("mode"),
        (F.length(text) < 60).alias("is_short"), F.contains(text, F.lit("?")).alias("is_question"),
        (qt.first_rule(text, [("yes", r"\bfree|gratis")], "no") == "yes").alias("wants_free"))


@query("h3_9_clause_intents", f"""
    WITH cl AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[?;,.]'),
                    lambda c: trim(regexp_replace(regexp_replace(c, '^[ ,.]+', ''), '[ ,.]+$', ''))), lambda c: c <> '') AS c FROM conversations)
    , l AS (SELECT conv_id, turn, unnest(c[1:5]) AS clause, unnest(range(len(c[1:5]))) AS pos FROM cl WHERE len(c) >= 2)
    , b AS (SELECT *, {bare_sql(norm_sql('clause'))} AS b FROM l)
    , n AS (SELECT *, CASE WHEN list_contains(string_split(b, ' '), 'the') THEN 'what is' END AS entity FROM b)
    , t AS (SELECT *, last_value(entity IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lent FROM n)
    , i AS (SELECT *, coalesce({_intent_sql('b')}, CASE WHEN lent IS NOT NULL THEN {_intent_sql("(lent || ' ' || b)")} END) AS intent FROM t)
    , f AS (SELECT conv_id, turn, intent, min(pos) AS pos FROM i WHERE intent IS NOT NULL GROUP BY 1, 2, 3)
    , k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS place, count(*) OVER (PARTITION BY conv_id, turn) AS m FROM f)
    SELECT conv_id, turn, place, intent, cast(pos AS INTEGER) AS pos FROM k WHERE m >= 2 AND place <= 3""")
def clause_intents(t: Tables) -> DataFrame:
    keyed = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    out = qt.clause_intents(keyed, "key", "text", INTENTS, {"what is": ["the"]}, r"[?;,.]")
    return out.select("key.conv_id", "key.turn", F.col("place").cast("bigint").alias("place"), "intent", "pos")


@query("h3_10_matched_keywords", f"""
    WITH {ITEMS_SQL}, {QUERY_GRAMS}, {BM25_SQL}, hits AS MATERIALIZED (SELECT query_id, item_id FROM ({top_sql('bm25', 'bm25', 10)}))
    , q AS (SELECT query_id, {tokens_sql('query', 3)} AS toks FROM queries)
    , w AS (SELECT query_id, word, min(p) AS p FROM (SELECT query_id, unnest(toks) AS word, unnest(range(len(toks))) AS p FROM q) GROUP BY 1, 2)
    , d AS (SELECT query_id, item_id, {norm_sql('description')} AS n FROM hits JOIN items USING (item_id))
    , h AS (SELECT query_id, item_id, word, row_number() OVER (PARTITION BY query_id, item_id ORDER BY p) AS r FROM w JOIN d USING (query_id)
            WHERE contains(n, word) OR (length(word) >= 5 AND contains(' ' || n, ' ' || left(word, 5))))
    SELECT query_id, item_id, coalesce(string_agg(word, ' ' ORDER BY r) FILTER (r <= 5), '') AS keywords FROM h GROUP BY 1, 2""")
def matched_keywords(t: Tables) -> DataFrame:
    """Words of each query that its ten best documents hold."""
    best = search.top_n(search.bm25_scores(items(t), queries(t), LEXICON).withColumnRenamed("bm25", "score"), 10)
    pairs = best.select("query_id", "item_id").join(queries(t), "query_id").join(items(t).select("item_id", "description"), "item_id")
    words = qt.matched_keywords(F.col("query"), F.col("description"), tx.STOP_WORDS)
    return pairs.select("query_id", "item_id", F.array_join(words, " ").alias("keywords")).filter("keywords <> ''")


@query("h3_11_noisy_queries")
def noisy_queries(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", qt.add_noise(F.col("text"), 7).alias("noisy"))


@query("h3_12_natural_queries", f"""
    SELECT item_id, array_to_string(list_filter(list_filter(list_transform(regexp_split_to_array(string_split(text, '. ')[1], '\\s+'),
        lambda w: regexp_replace(regexp_replace(w, '^[.,:;()"'']+', ''), '[.,:;()"'']+$', '')), lambda w: w <> ''),
        lambda w: NOT (regexp_matches(w, '^[\\x00-\\x7F]+$') AND list_contains(['the', 'of', 'and', 'der'], lower(w))))[1:28], ' ') AS query
    FROM benchmark""")
def natural_queries(t: Tables) -> DataFrame:
    masked = F.array(*[F.lit(w) for w in ("the", "of", "and", "der")])
    return t.benchmark.select("item_id", qt.natural_query(F.col("text"), masked).alias("query"))


@query("e8_follow_up_context", f"""
    WITH u AS (SELECT *, len(regexp_split_to_array(trim(text), '\\s+')) <= 8 AND (NOT list_contains({words_sql('text')}, 'the')
                      OR regexp_matches({bare_sql('text')}, '\\b(of|et)\\b')) AS needs FROM conversations WHERE role = 'user')
    , c AS (SELECT a.conv_id, a.turn, b.turn AS said_at, b.text AS said, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS r
            FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 4 AND a.turn - 1 WHERE a.needs)
    SELECT u.conv_id, u.turn, concat_ws(' ', ctx, text) AS resolved, ctx IS NOT NULL AS prefixed FROM u LEFT JOIN (
        SELECT conv_id, turn, string_agg(said, ' ' ORDER BY said_at) AS ctx FROM c WHERE r <= 2 GROUP BY 1, 2) USING (conv_id, turn)""")
def follow_up_context(t: Tables) -> DataFrame:
    entity = F.array_contains(tx.words(F.col("text")), "the")
    return qt.follow_up_context(t.conversations, "conv_id", "turn", "role", "text", entity, r"\b(of|et)\b")


# --------------------------------------------------------------------- skills

ROLE_SQL = """bought AS MATERIALIZED (SELECT o_custkey AS user_id, p_brand AS skill, min(o_orderdate) AS first_day FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40 GROUP BY 1, 2)
, roadmap AS (SELECT p_type AS role, p_brand AS skill, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS ord
    FROM part GROUP BY p_type, p_brand)"""


def _bought(t: Tables) -> DataFrame:
    """Brands of large order lines as the skills a customer has."""
    lines = t.lineitem.filter("l_quantity > 40").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("skill")).agg(F.min("o_orderdate").alias("first_day"))


def _roadmap(t: Tables) -> DataFrame:
    """Brands of a part type, most frequent first, as the roadmap of a role."""
    counts = t.part.groupBy(F.col("p_type").alias("role"), F.col("p_brand").alias("skill")).agg(F.count(F.lit(1)).alias("n"))
    return group_positions(counts, ["role"], [F.desc("n"), F.col("skill")], -F.col("n"), "ord").select("role", "skill", F.col("ord").cast("int").alias("ord"))


@query("p1_skill_gap", f"""WITH {ROLE_SQL}
    SELECT c_custkey AS user_id, skill, cast(ord AS INTEGER) AS ord FROM customer JOIN roadmap ON role = CASE c_mktsegment WHEN 'BUILDING' THEN 'PROMO' ELSE 'SMALL' END
    WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.user_id = c_custkey AND b.skill = roadmap.skill)""")
def skill_gap(t: Tables) -> DataFrame:
    role = F.when(F.col("c_mktsegment") == "BUILDING", "PROMO").otherwise("SMALL")
    wanted = t.customer.select(F.col("c_custkey").alias("user_id"), role.alias("role")).join(_roadmap(t), "role")
    return sk.skill_gap(wanted, _bought(t)).select("user_id", "skill", "ord")


@query("p2_next_skills", f"""WITH {ROLE_SQL}
    , edges AS (SELECT p_brand AS src, 'Brand#' || p_size AS dst, min(p_partkey) AS ord FROM part GROUP BY 1, 2)
    , steps AS (SELECT user_id, dst, min((first_day, skill, ord)) AS seen FROM bought JOIN edges ON skill = src GROUP BY 1, 2)
    SELECT user_id, dst AS skill, row_number() OVER (PARTITION BY user_id ORDER BY seen, dst) AS rank FROM steps s
    WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.user_id = s.user_id AND b.skill = s.dst) QUALIFY rank <= 6""")
def next_skills(t: Tables) -> DataFrame:
    edges = t.part.groupBy(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("dst")).agg(
        F.min("p_partkey").alias("ord"))
    known = _bought(t).withColumn("place", F.struct("first_day", "skill")).select("user_id", "skill", "place")
    return sk.next_skills(known, edges).select("user_id", "skill", F.col("rank").cast("bigint").alias("rank"))


@query("d23_roadmap_effort", f"""WITH {ROLE_SQL}
    SELECT role, count(*) AS n_skills, count(*) * 35 AS hours, cast(round_even(count(*) * 35 / 12 / 4.3, 0) AS INTEGER) AS months_low,
           cast(round_even(count(*) * 35 / 8 / 4.3, 0) AS INTEGER) AS months_high FROM roadmap GROUP BY 1""")
def roadmap_effort(t: Tables) -> DataFrame:
    return sk.roadmap_effort(_roadmap(t))
