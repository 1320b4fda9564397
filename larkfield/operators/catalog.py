"""Catalog building: conforming columns, deduplication, enrichment."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.operators.ranking import keep_first
from larkfield.session import durable, last_read


def conform(df: DataFrame, aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """One schema out of differently named columns: the first alias present wins, ignoring case."""
    present = {c.lower().strip(): c for c in df.columns}
    columns = []
    for name, options in aliases.items():
        source = next((present[o.lower()] for o in options if o.lower() in present), None)
        value = F.col(f"`{source}`").cast("string") if source else F.lit((defaults or {}).get(name)).cast("string")
        columns.append(value.alias(name))
    return df.select(*columns)


def concat_catalogs(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames by column name; missing columns become null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int | Column = 1) -> DataFrame:
    """Consecutive numbers along a total order without a single-task sort.

    Rows are range-partitioned and written once; positions inside a part come
    from the partition-local row id, and part offsets from one count per part.
    """
    local = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("_at", F.monotonically_increasing_id()))
    written = durable(local)
    fixed = written.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at") % F.lit(1 << 33)})
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    numbered = fixed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_row") + first)
    return last_read(numbered.drop("_at", "_part", "_row", "_before"), written)


def dedupe_titles(df: DataFrame, title: str, description: str, seq: str) -> DataFrame:
    """One item per normal title, the one with the longest description, in original order."""
    keyed = df.withColumn("_key", tx.normalize_text(F.col(title)))
    kept = keep_first(keyed, ["_key"], [F.length(description).desc(), F.col(seq)])
    return kept.drop("_key")


def composed(df: DataFrame, column: str) -> DataFrame:
    """Text in composed Unicode form; only rows with combining marks leave the JVM."""
    marks = F.coalesce(F.col(column).rlike(r"\p{M}"), F.lit(False))

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFC", v))

    plain = df.filter(~marks)
    return plain.unionByName(df.filter(marks).withColumn(column, nfc(column)))


def enrich_missing(df: DataFrame, column: str, cache: DataFrame, fn: Callable[[pd.Series], pd.Series],
                   name: str = "enriched") -> tuple[DataFrame, DataFrame]:
    """Map texts through an expensive function once per distinct text not yet in ``cache(text, value)``.

    Returns the enriched table and the cache rows to append. Texts without a
    value keep themselves.
    """
    todo = (df.select(F.col(column).alias("text")).filter(F.trim("text") != "").distinct()
            .join(cache.select("text"), "text", "left_anti"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"text": part["text"], "value": fn(part["text"])})

    fresh = todo.mapInPandas(run, "text string, value string")
    known = cache.select("text", "value").unionByName(fresh)
    out = df.join(known.select(F.col("text").alias(column), F.col("value").alias("_value")), column, "left")
    return out.withColumn(name, F.coalesce("_value", column)).drop("_value"), fresh


def map_level(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First rule whose word occurs in the text gives the level."""
    low = F.lower(F.trim(text))
    out = None
    for word, level in rules:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise(default)


def difficulty(level: Column, text: Column, levels: Mapping[str, int], beginner: Sequence[str],
               advanced: Sequence[str]) -> Column:
    """0, 1 or 2: a known level wins, then beginner words, then advanced words, else 1."""
    named = None
    bare = tx.strip_accents(F.trim(F.coalesce(level, F.lit(""))))
    for name, rank in levels.items():
        named = F.when(bare == name, rank) if named is None else named.when(bare == name, rank)

    def any_of(terms: Sequence[str]) -> Column:
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(tx.strip_accents(text), F.lit(term))
        return hit

    return F.coalesce(named, F.when(any_of(beginner), 0).when(any_of(advanced), 2).otherwise(1))
