"""Queries of the training-data operators over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm.chat import ENTITIES, format_chats, read_chats
from larkfield.llm.common import Scratch, shared_folder
from larkfield.llm.decontaminate import leaked_passages
from larkfield.llm.extract import extract_text
from larkfield.llm.hard_negatives import hard_negatives
from larkfield.llm.lexical import ranked_search
from larkfield.llm.near_dedup import near_duplicates
from larkfield.llm.packing import pack
from larkfield.llm.quality import quality_scores
from larkfield.llm.suffixes import repeated_passages
from larkfield.llm.token_files import read_token_files, write_token_files
from larkfield.llm.toxicity import toxicity_scores
from larkfield.llm.vectors import near_vectors
from larkfield.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def wrap(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query()
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), shingle=2)


@_query()
def op3_best_two_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def _scores(spark: SparkSession, folder: str, scorer, label: str, folds: int, held: int) -> DataFrame:
    """Scores of all documents, learned from the labels outside the held-out fold."""
    fold = lambda column: F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)) == held
    labels = _table(spark, folder, "labels").where(~fold("doc_id"))
    scored = scorer(_table(spark, folder, "documents"), labels, label_col=label)
    return scored.select("doc_id", fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query()
def op6_quality_nb_svm(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder, quality_scores, "quality", 5, 0)


@_query()
def op9_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder, toxicity_scores, "toxic", 4, 2)


def _escaped_length(column: str) -> str:
    for plain, entity in ENTITIES:
        column = f"replace({column}, '{plain}', '{entity}')"
    return f"length({column})"


OP8_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum({_escaped_length('text')} + CASE WHEN opens THEN 6 + {_escaped_length('role')} ELSE 3 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@_query(OP8_SQL)
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = Scratch(spark).keep(format_chats(rows.unionByName(probe)), "chats")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@_query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND winner != page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND winner != page_id THEN winner END AS refers_to
FROM w
""")
def op2_warc_shards(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "archives")
    write_archives(_table(spark, folder, "pages"), archives)
    return read_archives(spark, archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query()
def op4_wrapper_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = extract_text(_table(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@_query()
def op5_sparse_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_passages(_table(spark, folder, "documents"))
    return found.select("doc_id", "spans", F.size("spans").alias("n_spans"), F.length("rest").cast("bigint").alias("rest_chars"), "kept_in")


@_query()
def op10_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query()
def op7_pruned_graph_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


@_query()
def op11_plane_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark, "token-files")
    write_token_files(_table(spark, folder, "documents"), files)
    return read_token_files(spark, files)


@_query("""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // words) AS m FROM sizes, totals),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""")
def op12_norm_bucket_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 100 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS alike, list_inner_product(a.parts, r.parts)::BIGINT AS score
  FROM a JOIN r ON a.vec_id != r.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""")
def op13_threshold_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@_query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
