"""Corpus pipeline over ``documents``: stages applied in order, each reading what the one before wrote.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet before the next
one starts. All but the last return the columns of their input. Decisions are made per row: rows that repeat an id or
have none are told apart by a mark of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch
from larkfield.llm.decontaminate import leaked_passages
from larkfield.llm.near_dedup import near_duplicates
from larkfield.llm.packing import pack
from larkfield.llm.quality import quality_scores, sized
from larkfield.llm.suffixes import cut_repeats

#: Documents whose probability of good quality is below this go.
LEAST_QUALITY = 0.3


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: ``doc_id`` where it does, else a new one in a written copy.

    In the copy a smaller mark stands for a smaller id (none last); the text's hash and then the row's place order rows of one id.
    """
    ids = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if ids.isEmpty():
        return docs, "doc_id"
    mark = "doc_row"
    while mark in docs.columns:
        mark += "_"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col(mark)]
    placed = docs.withColumn(mark, F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    return Scratch(docs.sparkSession).keep(ordered, "marked"), mark


def _without(docs: DataFrame, gone: DataFrame, mark: str, columns: list[str]) -> DataFrame:
    """``docs`` less the marked rows; the list of marks is sent to all tasks only within a bound."""
    gone = Scratch(docs.sparkSession).keep(gone.select(mark).distinct(), "gone")
    return docs.join(sized(gone), mark, "left_anti").select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, learned from ``labels``, rejects."""
    Scratch.drop_finished()
    rows, mark = _marked(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if mark != "doc_id":  # a label counts for every row of its document
        labels = rows.select("doc_id", mark).join(labels, "doc_id").select(mark, "quality")
    scores = quality_scores(rows, labels, id_col=mark)
    return _without(rows, scores.where(F.col("score") < LEAST_QUALITY), mark, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates on five-word shingles."""
    Scratch.drop_finished()
    rows, mark = _marked(docs)
    return _without(rows, near_duplicates(rows, id_col=mark, shingle=5).where(~F.col("kept")), mark, docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of fifty words and more that a document with a smaller id has too."""
    Scratch.drop_finished()
    cut = cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of ``benchmark``."""
    Scratch.drop_finished()
    rows, mark = _marked(docs)
    leaks = leaked_passages(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=mark)
    return _without(rows, leaks, mark, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of documents in sequences of 2048 tokens."""
    Scratch.drop_finished()
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: Classifiers, sketches and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = Scratch(spark, lasting=True)
    for name, stage in STAGES[:-1]:
        docs = written.keep(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
