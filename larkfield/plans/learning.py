"""Learning domain: interactions, social tables, listings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators import feed, graph, interactions, profile, ranking
from larkfield.plans import entities as e
from larkfield.plans.entities import with_entities
from larkfield.plans.registry import Tables, query


# -------------------------------------------------------------- interactions

@query("b10_enrolment_events", with_entities("enrollments") + """
    SELECT user_id, course_id AS item_id, status AS event_type, updated_at AS event_time FROM enrollments
    WHERE user_id IS NOT NULL AND course_id IS NOT NULL AND status IN ('in_progress', 'completed')""")
def enrolment_events(t: Tables) -> DataFrame:
    return interactions.enrolment_events(e.enrollments(t))


def _lessons(t: Tables) -> DataFrame:
    """One lesson per item number; lesson n belongs to course 99 - n."""
    return e.event_items(t).select(F.col("item_id").alias("lesson_id")).distinct().withColumn(
        "course_id", 99 - F.col("lesson_id"))


def _lesson_progress(t: Tables) -> DataFrame:
    return e.event_items(t).filter("event_type = 'signup'").select(
        "user_id", F.col("item_id").alias("lesson_id"), F.col("ts").alias("completed_at"))


LESSON_SQL = """, lessons AS (SELECT DISTINCT item_id lesson_id, 99 - item_id course_id FROM event_items)
    , progress AS (SELECT user_id, item_id lesson_id, ts completed_at FROM event_items WHERE event_type = 'signup')"""
INTERACTION_SQL = LESSON_SQL + """, interaction AS (
    SELECT user_id, item_id, event_type, event_time FROM (
        SELECT user_id, course_id item_id, status event_type, updated_at event_time FROM enrollments
        WHERE status IN ('in_progress', 'completed')
        UNION ALL SELECT user_id, course_id, 'lesson_completed', completed_at FROM progress JOIN lessons USING (lesson_id))
    QUALIFY row_number() OVER (PARTITION BY user_id, item_id, event_type ORDER BY event_time) = 1)"""


@query("c7_lesson_events", with_entities("event_items") + LESSON_SQL + """
    SELECT user_id, course_id AS item_id, 'lesson_completed' AS event_type, completed_at AS event_time
    FROM progress JOIN lessons USING (lesson_id)""")
def lesson_events(t: Tables) -> DataFrame:
    return interactions.lesson_events(_lesson_progress(t), _lessons(t))


def interaction(t: Tables) -> DataFrame:
    return interactions.interaction_events(e.enrollments(t), _lesson_progress(t), _lessons(t))


@query("g1_interaction_union", with_entities("event_items", "enrollments") + INTERACTION_SQL + "SELECT * FROM interaction")
def interaction_union(t: Tables) -> DataFrame:
    return interaction(t)


def _courses(t: Tables) -> DataFrame:
    """Categories for the first items only, so some items stay without one."""
    return t.nation.select(F.col("n_nationkey").cast("bigint").alias("item_id"), F.col("n_name").alias("category"))


FACT_SQL = INTERACTION_SQL + """, fact AS (SELECT user_id, item_id, n_name category, event_type, event_time
    FROM interaction LEFT JOIN nation ON n_nationkey = item_id)"""


def fact(t: Tables) -> DataFrame:
    return interactions.fact_interaction(interaction(t), _courses(t))


@query("c6_fact_interaction", with_entities("event_items", "enrollments") + FACT_SQL + "SELECT * FROM fact")
def fact_interaction(t: Tables) -> DataFrame:
    return fact(t)


@query("d3_course_popularity", with_entities("event_items", "enrollments") + FACT_SQL + """
    SELECT category, count(*) AS interactions, count(DISTINCT user_id) AS distinct_users,
           count(DISTINCT item_id) AS distinct_courses FROM fact GROUP BY category ORDER BY interactions DESC""")
def course_popularity(t: Tables) -> DataFrame:
    return fact(t).groupBy("category").agg(
        F.count(F.lit(1)).alias("interactions"), F.countDistinct("user_id").alias("distinct_users"),
        F.countDistinct("item_id").alias("distinct_courses")).orderBy(F.desc("interactions"), "category")


@query("d4_completion_funnel", with_entities("event_items", "enrollments") + FACT_SQL + """
    SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS distinct_users FROM fact GROUP BY 1""")
def completion_funnel(t: Tables) -> DataFrame:
    return fact(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"),
                                             F.countDistinct("user_id").alias("distinct_users"))


@query("a11_distinct_pairs_export", with_entities("event_items", "enrollments") + INTERACTION_SQL + """
    SELECT DISTINCT user_id, item_id FROM interaction WHERE user_id IS NOT NULL AND item_id IS NOT NULL
      AND (SELECT count(DISTINCT user_id) FROM interaction) >= 50""")
def distinct_pairs_export(t: Tables) -> DataFrame:
    return interactions.distinct_pairs(interaction(t), 50)


@query("g4_distinct_pairs", with_entities("event_items") + "SELECT DISTINCT user_id, item_id FROM event_items")
def distinct_pairs(t: Tables) -> DataFrame:
    return e.event_items(t).select("user_id", "item_id").distinct()


@query("j5_interaction_builder", with_entities("event_items", "enrollments") + INTERACTION_SQL + """
    SELECT user_id, item_id, count(*) AS n_events, min(event_time) AS first_seen FROM interaction GROUP BY 1, 2""")
def interaction_builder(t: Tables) -> DataFrame:
    return interaction(t).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n_events"),
                                                            F.min("event_time").alias("first_seen"))


@query("d19_course_progress", with_entities("baskets") + """
    , lessons AS (SELECT p_partkey lesson_id, p_brand course_id, p_size > 10 approved FROM part)
    , totals AS (SELECT course_id, count(*) total FROM lessons WHERE approved GROUP BY 1)
    , done AS (SELECT user_id, course_id, count(*) done FROM (SELECT DISTINCT user_id, item_id FROM baskets)
               JOIN lessons ON lesson_id = item_id GROUP BY 1, 2)
    , p AS (SELECT user_id, course_id, done, coalesce(total, 0) total,
                   cast(CASE WHEN total > 0 THEN round(done / total * 100) ELSE 0 END AS INTEGER) progress
            FROM done LEFT JOIN totals USING (course_id))
    SELECT *, CASE WHEN progress >= 100 THEN 'completed' WHEN progress > 0 THEN 'in_progress' ELSE 'saved' END AS status
    FROM p""")
def course_progress(t: Tables) -> DataFrame:
    lessons = t.part.select(F.col("p_partkey").alias("lesson_id"), F.col("p_brand").alias("course_id"),
                            (F.col("p_size") > 10).alias("approved"))
    return interactions.course_progress(lessons, e.baskets(t).withColumnRenamed("item_id", "lesson_id"))


@query("e5_history_split", with_entities("event_items") + """
    SELECT user_id, event_id, item_id, CASE WHEN pos <= greatest(1, floor(n * 0.7)) THEN 'train' ELSE 'test' END AS part
    FROM (SELECT user_id, event_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) pos,
                 count(*) OVER (PARTITION BY user_id) n FROM event_items) WHERE n >= 4""")
def history_split(t: Tables) -> DataFrame:
    from larkfield.operators.cf import split_history
    out = split_history(e.event_items(t), "user_id", [F.col("ts"), F.col("event_id")], F.to_date("ts"))
    return out.select("user_id", "event_id", "item_id", "part")


@query("d12_most_common_event", """
    SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def most_common_event(t: Tables) -> DataFrame:
    return profile.most_common(t.events, ["user_id"], "event_type")


@query("d20_item_lists", with_entities("event_items") + """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, item_id) AS pos, item_id
    FROM (SELECT user_id, item_id, min(ts) first_ts FROM event_items GROUP BY 1, 2)""")
def item_lists(t: Tables) -> DataFrame:
    first = e.event_items(t).groupBy("user_id", "item_id").agg(F.min("ts").alias("first_ts"))
    out = ranking.group_positions(first, ["user_id"], [F.col("first_ts"), F.col("item_id")], F.to_date("first_ts"))
    return out.select("user_id", "pos", "item_id")


@query("d21_request_report", """
    SELECT event_type AS route, count(*) AS requests, round(avg(value), 6) AS mean_latency,
           max(value) AS max_latency, count(*) FILTER (value > 50) AS errors FROM events GROUP BY 1""")
def request_report(t: Tables) -> DataFrame:
    log = t.events.withColumnRenamed("event_type", "route")
    out = interactions.request_report(log, "route", "value", F.col("value") > 50)
    return out.withColumn("mean_latency", F.round("mean_latency", 6))


@query("d22_latency_percentiles", """
    SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean,
           round(1000 * count(*) / sum(value), 6) AS per_second FROM events GROUP BY 1""")
def latency_percentiles(t: Tables) -> DataFrame:
    log = t.events.withColumnRenamed("event_type", "stage")
    q = ranking.exact_quantiles(log, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys=["stage"])
    m = log.groupBy("stage").agg(F.round(F.avg("value"), 6).alias("mean"),
                                 F.round(1000 * F.count(F.lit(1)) / F.sum("value"), 6).alias("per_second"))
    return q.join(m, "stage").withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


# ------------------------------------------------------------------- look-ups

@query("c9_label_texts", """
    SELECT l.doc_id, quality, left(text, 240) AS excerpt FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def label_texts(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id", "left").select("doc_id", "quality", F.left("text", F.lit(240)).alias("excerpt"))


@query("c10_label_override", """
    SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS label,
           l.quality IS NOT NULL AS filled
    FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON d.doc_id = l.doc_id""")
def label_override(t: Tables) -> DataFrame:
    auto = t.documents.select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("auto"))
    human = t.labels.filter("toxic = 0").select("doc_id", "quality")
    return auto.join(human, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", "auto").alias("label"), F.col("quality").isNotNull().alias("filled"))


@query("c11_known_items", with_entities("event_items") + """
    SELECT event_id, user_id, item_id, EXISTS (SELECT 1 FROM event_items p WHERE p.event_type = 'purchase'
        AND p.user_id = x.user_id AND p.item_id = x.item_id) AS bought
    FROM event_items x WHERE item_id IN (SELECT n_nationkey FROM nation)""")
def known_items(t: Tables) -> DataFrame:
    known = e.event_items(t).join(_courses(t).select("item_id"), "item_id", "left_semi")
    bought = e.event_items(t).filter("event_type = 'purchase'")
    return feed.with_flag(known, bought, ["user_id", "item_id"], "bought").select(
        "event_id", "user_id", "item_id", "bought")


@query("c12_unseen_items", with_entities("event_items") + """
    SELECT DISTINCT user_id, item_id FROM event_items v WHERE event_type = 'view' AND NOT EXISTS (
        SELECT 1 FROM event_items p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.item_id = v.item_id)""")
def unseen_items(t: Tables) -> DataFrame:
    items = e.event_items(t)
    seen = items.filter("event_type = 'purchase'").select("user_id", "item_id")
    return items.filter("event_type = 'view'").select("user_id", "item_id").distinct().join(
        seen, ["user_id", "item_id"], "left_anti")


# --------------------------------------------------------------------- social

def _requests(t: Tables) -> DataFrame:
    """Clicks and purchases as friend requests from user to item number; a purchase accepts."""
    edges = e.event_items(t).filter(F.col("event_type").isin("click", "purchase") & (F.col("user_id") != F.col("item_id")))
    return edges.groupBy(F.col("user_id").alias("requester"), F.col("item_id").alias("addressee")).agg(
        F.when(F.max((F.col("event_type") == "purchase").cast("int")) == 1, "accepted").otherwise("pending").alias("status"))


@query("c14_friend_states", with_entities("event_items") + """
    , edges AS (SELECT user_id a, item_id b, bool_or(event_type = 'purchase') accepted FROM event_items
                WHERE event_type IN ('click', 'purchase') AND user_id <> item_id GROUP BY 1, 2)
    , both_ways AS (SELECT a node, b neighbour, 1 s, 0 r, accepted FROM edges
                    UNION ALL SELECT b, a, 0, 1, accepted FROM edges)
    SELECT node, neighbour, CASE WHEN bool_or(accepted) THEN 'friends' WHEN max(s) = 1 THEN 'pending_sent'
           ELSE 'pending_received' END AS state, max(s) + max(r) = 2 AS mutual FROM both_ways GROUP BY 1, 2""")
def friend_states(t: Tables) -> DataFrame:
    return graph.friendship_state(_requests(t), "requester", "addressee", "status")


@query("c15_child_counts", """
    SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
           (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer""")
def child_counts(t: Tables) -> DataFrame:
    return feed.with_counts(t.customer.select("c_custkey"), "c_custkey", {
        "orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")})


def _posts(t: Tables) -> DataFrame:
    """Orders as posts; a pending order shares the post of half its number."""
    return t.orders.select(
        F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("content"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") > 0), F.floor(F.col("o_orderkey") / 2))
        .cast("bigint").alias("shared_from"))


@query("c16_feed_posts", """
    WITH RECURSIVE posts AS (SELECT o_orderkey post_id, o_custkey user_id, o_orderpriority content,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey > 0 THEN o_orderkey // 2 END shared_from FROM orders)
    , chain AS (SELECT post_id, coalesce(shared_from, post_id) up FROM posts
        UNION SELECT chain.post_id, p.shared_from FROM chain JOIN posts p ON chain.up = p.post_id
              WHERE p.shared_from IS NOT NULL)
    , origin AS (SELECT post_id, min(up) origin FROM chain GROUP BY 1)
    SELECT p.post_id, c_name AS author, p.content, (SELECT count(*) FROM lineitem WHERE l_orderkey = p.post_id) AS n_likes,
           CASE WHEN p.shared_from IS NOT NULL THEN origin END AS origin_id,
           CASE WHEN p.shared_from IS NOT NULL THEN op.content END AS origin_content
    FROM posts p JOIN customer ON c_custkey = p.user_id JOIN origin o ON o.post_id = p.post_id
    JOIN posts op ON op.post_id = origin""")
def feed_posts(t: Tables) -> DataFrame:
    posts = feed.resolve_shares(_posts(t), "post_id", "shared_from")
    posts = feed.with_counts(posts, "post_id", {"likes": (t.lineitem, "l_orderkey")})
    first = _posts(t).select(F.col("post_id").alias("origin"), F.col("content").alias("first_content"))
    authors = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("author"))
    shared = F.col("shared_from").isNotNull()
    return posts.join(authors, "user_id").join(first, "origin", "left").select(
        "post_id", "author", "content", "n_likes", F.when(shared, F.col("origin")).alias("origin_id"),
        F.when(shared, F.col("first_content")).alias("origin_content"))


@query("c16_feed_comments", """
    SELECT l_orderkey AS post_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
               l_partkey, l_suppkey, l_extendedprice) AS pos, s_name AS author, l_returnflag AS content
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def feed_comments(t: Tables) -> DataFrame:
    comments = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = ranking.group_positions(comments, ["l_orderkey"], order, F.to_date("l_shipdate"))
    return out.select(F.col("l_orderkey").alias("post_id"), "pos", F.col("s_name").alias("author"),
                      F.col("l_returnflag").alias("content"))


def _messages(t: Tables) -> DataFrame:
    """Events as messages from user to item number; errors stay unread."""
    return e.event_items(t).select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("sender"), F.col("item_id").alias("recipient"),
        F.col("event_type").alias("content"), "ts", (F.col("event_type") == "error").alias("unread"))


@query("c17_message_threads", with_entities("event_items") + """
    SELECT event_id AS message_id, least(user_id, item_id) AS low, greatest(user_id, item_id) AS high,
           event_type AS content, event_type = 'error' AS unread, o_orderstatus AS shared_status
    FROM event_items LEFT JOIN orders ON o_orderkey = event_id""")
def message_threads(t: Tables) -> DataFrame:
    shared = t.orders.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("shared_status"))
    return graph.with_pair_key(_messages(t), "sender", "recipient").join(shared, "message_id", "left").select(
        "message_id", "low", "high", "content", "unread", "shared_status")


@query("c17_thread_summary", with_entities("event_items") + """
    SELECT least(user_id, item_id) AS low, greatest(user_id, item_id) AS high, count(*) AS n_messages,
           count(*) FILTER (event_type = 'error') AS n_unread, arg_max(event_id, (ts, event_id)) AS last_message
    FROM event_items GROUP BY 1, 2""")
def thread_summary(t: Tables) -> DataFrame:
    return graph.with_pair_key(_messages(t), "sender", "recipient").groupBy("low", "high").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if("unread").alias("n_unread"),
        F.max(F.struct("ts", "message_id"))["message_id"].alias("last_message"))


@query("c19_saved_courses", """
    SELECT c_custkey, c_name, o_orderkey, o_orderstatus, cast(o_orderdate AS DATE) AS updated_at
    FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY updated_at DESC, o_orderkey""")
def saved_courses(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus",
                         F.to_date("o_orderdate").alias("updated_at")).orderBy(F.desc("updated_at"), "o_orderkey")


@query("c20_review_queue", """
    SELECT o_orderkey, c_name AS parent_title, source AS uploader FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN documents ON doc_id = o_orderkey WHERE o_orderstatus = 'P'""")
def review_queue(t: Tables) -> DataFrame:
    waiting = t.orders.filter("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    uploads = t.documents.select(F.col("doc_id").alias("o_orderkey"), F.col("source").alias("uploader"))
    return waiting.join(uploads, "o_orderkey", "left").select(
        "o_orderkey", F.col("c_name").alias("parent_title"), "uploader")


# ------------------------------------------------------ listings and ordering

@query("e1_latest_order", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_order(t: Tables) -> DataFrame:
    return ranking.keep_first(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_orderstatus")


@query("e13_latest_per_owner", """
    SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def latest_per_owner(t: Tables) -> DataFrame:
    return ranking.top_per_group(t.conversations, ["conv_id"], [F.desc("turn")], 2).drop("rank")


@query("f1_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(t: Tables) -> DataFrame:
    return ranking.top_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


@query("f3_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def listing_page(t: Tables) -> DataFrame:
    return ranking.page(t.part.select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 20, 3)


@query("f4_sample")
def sample(t: Tables) -> DataFrame:
    """Random rows that do not depend on partitioning: order by a seeded hash."""
    return ranking.top_rows(t.orders.select("o_orderkey", "o_totalprice"),
                            [F.xxhash64("o_orderkey", F.lit(42)), F.col("o_orderkey")], 20)


@query("g2_tagged_union", """
    SELECT 'order' AS kind, o_orderkey AS id, o_orderpriority AS label FROM orders
    UNION ALL SELECT 'document', doc_id, source FROM documents
    UNION ALL SELECT 'part', p_partkey, p_name FROM part""")
def tagged_union(t: Tables) -> DataFrame:
    parts = [(t.orders, "order", "o_orderkey", "o_orderpriority"), (t.documents, "document", "doc_id", "source"),
             (t.part, "part", "p_partkey", "p_name")]
    frames = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"))
              for df, kind, key, label in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("b17_listing_filters", """
    SELECT p_partkey, p_name, p_type FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand LIKE '%Brand#1%'
      AND p_type IN ('PROMO', 'SMALL')""")
def listing_filters(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size").between(10, 30) & F.col("p_brand").contains("Brand#1")
                         & F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_name", "p_type")


@query("b18_title_search_page", """
    SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name ILIKE '%RING%') AS n_total FROM part
    WHERE p_name ILIKE '%RING%' ORDER BY p_partkey LIMIT 25 OFFSET 25""")
def title_search_page(t: Tables) -> DataFrame:
    hits = t.part.filter(F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name")
    total = hits.agg(F.count(F.lit(1)).alias("v")).scalar()
    return ranking.page(hits, [F.col("p_partkey")], 25, 2).withColumn("n_total", total)


@query("b19_length_flags", """
    SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label, octet_length(encode(text)) AS n_bytes, left(text, 60) AS head
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def length_flags(t: Tables) -> DataFrame:
    marks = t.labels.select("doc_id", F.lit(True).alias("m"))
    return t.documents.join(marks, "doc_id", "left").select(
        "doc_id", F.col("m").isNotNull().alias("has_label"), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.left("text", F.lit(60)).alias("head"))


@query("b11_review_dimension", "SELECT doc_id AS review_id, quality AS review_score FROM labels")
def review_dimension(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("review_id"), F.col("quality").alias("review_score"))
