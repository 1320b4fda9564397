"""Term tables: counts, vocabularies, TF-IDF weights, BM25 and char channels.

Terms are counted inside the row (in Arrow batches; :func:`counted` does it with expressions), so neither texts nor single tokens are
shuffled; what leaves a document is one row per distinct term. Norms and scores are added up before they are
shuffled by document. Per-term joins meet small sides (a bounded vocabulary, the terms of the queries);
their size is left to runtime statistics instead of a forced broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.functions.stems import stem
from larkfield.operators.catalog import number_rows
from larkfield.operators.dense import best_places
from larkfield.session import durable, last_read


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` as it is, unless it is so small that its scan would leave cores idle; then its rows are dealt out by ``key``.

    A table of more than one split per core is never moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").rstrip("bB") or "128m"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores, key) if size < cores * split else df


def counted(df: DataFrame, keys: Sequence[str], terms: Column, sizes: Column | None = None) -> DataFrame:
    """``keys, size, counts``: the number of terms of a row, and an array of its distinct terms with their counts.

    The counts are run lengths of the sorted array, found in one pass however long it is. ``sizes`` gives the
    times each term counts, as an array of the same length (0 leaves it out).
    """
    if sizes is None:
        ordered = df.select(*keys, F.sort_array(terms).alias("_all"))
        term = lambda i: F.get("_all", i)
    else:
        pairs = F.filter(F.arrays_zip(terms.alias("term"), sizes.alias("n")), lambda x: x["n"] > 0)
        ordered = df.select(*keys, F.sort_array(pairs).alias("_all"))
        term = lambda i: F.get("_all", i)["term"]
    last = F.size("_all") - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    starts = ordered.select(*keys, "_all", F.filter(places, lambda i: (i == 0) | (term(i) != term(i - 1))).alias("_starts"))
    length = lambda at, i: F.coalesce(F.get("_starts", i + 1), F.size("_all")) - at
    if sizes is None:
        size, times = F.size("_all"), length
    else:
        size = F.aggregate("_all", F.lit(0), lambda acc, x: acc + x["n"])
        times = lambda at, i: F.when(length(at, i) == 1, F.get("_all", at)["n"]).otherwise(
            F.aggregate(F.slice("_all", at + 1, length(at, i)), F.lit(0), lambda acc, x: acc + x["n"]))
    counts = F.transform("_starts", lambda at, i: F.struct(term(at).alias("term"), times(at, i).cast("bigint").alias("tf")))
    return starts.select(*keys, size.cast("bigint").alias("size"), counts.alias("counts"))


def term_rows(counts: DataFrame, *keys: str | Column) -> DataFrame:
    """One row ``keys, term, tf`` per entry of ``counts``.

    A plain explode infers a filter on the array's size and moves it below all projections, which would work the
    array out again for every part of it; the outer form doesn't.
    """
    return counts.select(*keys, F.explode_outer("counts").alias("_c")).filter(F.col("_c").isNotNull()).select(
        "*", "_c.term", "_c.tf").drop("_c")


#: Rows whose terms are held as Python strings at once.
ROWS_AT_ONCE = 200


def _lists(column: pa.Array) -> list[list | None]:
    """Values of a list column, converted in one go."""
    flat, sizes = column.flatten().to_pylist(), pc.list_value_length(column).to_pylist()
    out, low = [], 0
    for size in sizes:
        out.append(None if size is None else flat[low:low + size])
        low += size or 0
    return out


def word_grams(n: int) -> Callable:
    """Counts of the 1..n-grams (joined with ``_``) of a list of tokens; a gram counts as often as its first place says."""
    def count(tokens: list[str], times: list[int] | None) -> dict[str, int]:
        grams = [tokens, *(list(map("_".join, zip(*(tokens[by:] for by in range(k))))) for k in range(2, n + 1))]
        if times is None:
            return Counter(chain(*grams))
        found: dict[str, int] = {}
        for own in grams:
            for gram, often in zip(own, times):
                if often > 0:
                    found[gram] = found.get(gram, 0) + often
        return found

    return count


#: Words whose character grams a task remembers.
WORDS_AT_ONCE = 50_000


def char_grams(low: int, high: int) -> Callable:
    """Counts of the character grams inside words that are padded with one space."""
    seen: dict[str, list[str]] = {}

    def of_word(word: str) -> list[str]:
        if len(seen) >= WORDS_AT_ONCE:
            seen.clear()
        padded = f" {word} "
        seen[word] = [padded[i:i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1)]
        return seen[word]

    def count(words: list[str], times: None) -> dict[str, int]:
        found: dict[str, int] = {}
        for word, often in Counter(words).items():
            for gram in seen.get(word) or of_word(word):
                found[gram] = found.get(gram, 0) + often
        return found

    return count


def known_grams(n: int, known: Collection[str]) -> Callable:
    """:func:`word_grams` without those that hold a part (between ``_``) that is not ``known``."""
    def count(tokens: list[str], times: list[int] | None) -> dict[str, int]:
        marks = [t if t in known or ("_" in t and all(a in known for a in t.split("_"))) else None for t in tokens]
        found: dict[str, int] = {}
        for k in range(1, n + 1):
            for parts, often in zip(zip(*(marks[by:] for by in range(k))), times or repeat(1)):
                if often > 0 and None not in parts:
                    gram = "_".join(parts)
                    found[gram] = found.get(gram, 0) + often
        return found

    return count


#: Rows whose words are numbered at once, bits of a word's number, and what a number of a gram can hold.
ROWS_NUMBERED, WORD_BITS, PACKED = 2000, 21, 3


def numbered_grams(column: pa.ListArray, words: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of the ``low``..``high``-grams of token lists of which all tokens are in ``words``.

    The number holds those of the tokens (from 1), ``WORD_BITS`` each, so grams of other lengths have other numbers.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(pc.index_in(column.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    at, number, rows, places, numbers = np.flatnonzero(ids), ids, [], [], []
    for k in range(1, high + 1):
        if k > 1:
            at = at[at + k - 1 < len(ids)]
            at = at[(row[at + k - 1] == row[at]) & (ids[at + k - 1] > 0)]
            longer = np.zeros_like(number)
            longer[at] = number[at] | (ids[at + k - 1] << (WORD_BITS * (k - 1)))
            number = longer
        if k >= low:
            rows.append(row[at])
            places.append(at)
            numbers.append(number[at])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(numbers)


class Numbered:
    """Terms by the numbers of their words, for lists whose tokens hold no ``_``; :meth:`found` numbers the terms of a batch."""

    def __init__(self, terms: Sequence[str], n: int):
        split = [t.split("_") for t in terms]
        words = sorted({w for parts in split for w in parts})
        at = {w: i + 1 for i, w in enumerate(words)}
        self.words, self.n = pa.array(words, pa.string()), n
        # A term of more parts than a gram has words is no gram of such lists.
        pairs = sorted((sum(at[w] << (WORD_BITS * j) for j, w in enumerate(parts)), i) for i, parts in enumerate(split) if len(parts) <= n)
        self.numbers, self.terms = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)

    def found(self, tokens: pa.ListArray, times: pa.ListArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Row, term and count of each term of a row, or None where a token holds ``_``."""
        if pc.any(pc.match_substring(tokens.flatten(), "_")).as_py():
            return None
        row, place, number = numbered_grams(tokens, self.words, 1, self.n)
        at = np.searchsorted(self.numbers, number)
        hit = np.flatnonzero((at < len(self.numbers)) & (self.numbers[np.minimum(at, len(self.numbers) - 1)] == number)) if len(self.numbers) else np.empty(0, np.int64)
        if times is not None:
            hit = hit[times.flatten().to_numpy(zero_copy_only=False)[place[hit]] > 0]
        cell, back = np.unique(row[hit] * max(1, len(self.numbers)) + at[hit], return_inverse=True)
        often = None if times is None else times.flatten().to_numpy(zero_copy_only=False)[place[hit]]
        return cell // max(1, len(self.numbers)), self.terms[cell % max(1, len(self.numbers))], np.bincount(back, often, len(cell))


def gram_rows(df: DataFrame, key: str, lists: Sequence[tuple[str | None, str, str | None]], grams: Callable, total: bool = False) -> DataFrame:
    """``key, field, term, tf`` of token lists, counted row by row in Arrow batches.

    ``lists`` names each field with its column of tokens and, if places count several times, the column that says how often.
    A null list has no terms. With ``total`` every row has ``size``, the number of its terms, and a row without a term carries it.
    """
    names = [name for name, _, _ in lists]
    columns = [c for _, own, times in lists for c in (own, times) if c]

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                row, field, term, tf, size = [], [], [], [], []
                for name, own, times in lists:
                    tokens = _lists(batch.column(own))
                    often = _lists(batch.column(times)) if times else [None] * len(tokens)
                    for i, (t, o) in enumerate(zip(tokens, often)):
                        found = {} if t is None else grams(t, o)
                        if total:
                            n = sum(found.values())
                            row.append(i)
                            term.append(None)
                            tf.append(0)
                            size += [n] * (len(found) + 1)
                        row += [i] * len(found)
                        term += found
                        tf += found.values()
                    field += [name] * (len(row) - len(field))
                out = [batch.column(key).take(pa.array(row, pa.int64())), pa.array(field, pa.string()), pa.array(term, pa.string()), pa.array(tf, pa.int64())]
                named = [key, "field", "term", "tf"]
                if total:
                    out.append(pa.array(size, pa.int64()))
                    named.append("size")
                yield pa.RecordBatch.from_arrays(out, named)

    shape = f"{key} {df.schema[key].dataType.simpleString()}, field string, term string, tf long" + (", size long" if total else "")
    out = df.select(key, *columns).mapInArrow(run, shape)
    return out if names != [None] else out.drop("field")


def doc_terms(df: DataFrame, key: str, terms: Column, ngrams: int = 1, grams: Callable | None = None) -> DataFrame:
    """``(key, term, tf)`` out of an array of terms per row, with n-grams if asked for; one row of ``df`` per key.

    ``grams`` counts something else than n-grams of the array.
    """
    arrays = dealt(df, key).select(key, terms.alias("_toks"))
    return gram_rows(arrays, key, [(None, "_toks", None)], grams or word_grams(ngrams))


def row_total(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("v")).scalar()


def vocabulary(terms: DataFrame, n_docs: Column, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """Terms with document frequency, corpus count and smoothed idf.

    Terms in more than ``max_df`` of the documents are dropped, then the most
    frequent ``max_features`` are kept (ties by term).
    """
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_count"))
    stats = stats.withColumn("n_docs", n_docs).filter(F.col("df") <= max_df * F.col("n_docs"))
    if max_features is not None:
        stats = stats.orderBy(F.desc("corpus_count"), "term").limit(max_features)
    return stats.withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).drop("n_docs")


def field_vocabulary(terms: DataFrame, names: Sequence[str], n_docs: Column, **kw) -> DataFrame:
    """Vocabulary of every field of a written term table ``(field, term, tf)``."""
    out = None
    for name in names:
        one = vocabulary(terms.filter(F.col("field") == name), n_docs, **kw).withColumn("field", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


#: Terms that are sent with a task (longer vocabularies are joined), and entries of a task's counts before they are handed on.
TERMS_AT_ONCE, COUNTS_AT_ONCE = 400_000, 200_000


def term_counts(lists: DataFrame, fields: Sequence[tuple[str, str, str | None]], grams: Sequence[Callable], known: Broadcast | None = None) -> DataFrame:
    """``field, term, df, corpus_count`` of token lists (as in :func:`gram_rows`), added up inside tasks before they are shuffled.

    ``grams`` holds one way of counting per field; with ``known`` (one set per field) it makes the way from the set.
    """
    def run(batches):
        ways = [g if known is None else g(known.value[i]) for i, g in enumerate(grams)]
        counts = [({}, {}) for _ in fields]

        def handed_on():
            for (name, _, _), (rows, places) in zip(fields, counts):
                out = [pa.array([name] * len(rows), pa.string()), pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()),
                       pa.array(list(places.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["field", "term", "df", "corpus_count"])
                rows.clear()
                places.clear()

        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                for (_, own, times), (rows, places), way in zip(fields, counts, ways):
                    tokens = _lists(batch.column(own))
                    for t, o in zip(tokens, _lists(batch.column(times)) if times else repeat(None)):
                        for term, n in (way(t, o) if t is not None else {}).items():
                            rows[term] = rows.get(term, 0) + 1
                            places[term] = places.get(term, 0) + n
                if sum(len(rows) for rows, _ in counts) > COUNTS_AT_ONCE:
                    yield from handed_on()
        yield from handed_on()

    columns = [c for _, own, times in fields for c in (own, times) if c]
    parts = lists.select(*columns).mapInArrow(run, "field string, term string, df long, corpus_count long")
    return parts.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("corpus_count").alias("corpus_count"))


def _atoms(tokens: list[str], times: list[int] | None) -> dict[str, int]:
    """Counts of tokens and, for those that hold ``_``, of what lies between (marked by a leading blank)."""
    found: dict[str, int] = {}
    for token, often in zip(tokens, times or repeat(1)):
        if often > 0:
            if "_" not in token:
                found[token] = found.get(token, 0) + often
            else:
                for part in token.split("_"):
                    found[f" {part}"] = found.get(f" {part}", 0) + often
    return found


def _merged(number: np.ndarray, row: np.ndarray, often: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, the rows that hold each, and their places."""
    own, back = np.unique(number, return_inverse=True)
    pairs = np.unique(row * max(1, len(own)) + back)
    return own, np.bincount(pairs % max(1, len(own)), minlength=len(own)), np.bincount(back, often, len(own)).astype(np.int64)


def _often(batch: pa.RecordBatch, times: str | None, places: np.ndarray | None = None) -> np.ndarray | None:
    if times is None:
        return None
    every = batch.column(times).flatten().to_numpy(zero_copy_only=False)
    return every if places is None else every[places]


def word_counts(lists: DataFrame, fields: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """``field, term, df, corpus_count`` of the words of token lists; a word that holds ``_`` is counted like any other."""
    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_NUMBERED):
                batch = whole.slice(low, ROWS_NUMBERED)
                for name, own, times in fields:
                    tokens = batch.column(own)
                    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                    coded = tokens.flatten().dictionary_encode()
                    number, often = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _often(batch, times)
                    if often is not None:
                        row, number, often = (x[often > 0] for x in (row, number, often))
                    found, rows, places = _merged(number, row, often)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), coded.dictionary.take(pa.array(found)).cast(pa.string()),
                                                      pa.array(rows, pa.int64()), pa.array(places)], ["field", "term", "df", "corpus_count"])

    columns = [c for _, own, times in fields for c in (own, times) if c]
    parts = lists.select(*columns).mapInArrow(run, "field string, term string, df long, corpus_count long")
    return parts.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("corpus_count").alias("corpus_count"))


def _gram_counts(lists: DataFrame, fields: Sequence[tuple[str, str, str | None]], k: int, sent: Broadcast) -> DataFrame:
    """``field, number, df, corpus_count`` of k-grams of known words (as arrays per field) whose shorter grams are known as well."""
    def run(batches):
        words, shorter = sent.value
        mask = (1 << (WORD_BITS * (k - 1))) - 1
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_NUMBERED):
                batch = whole.slice(low, ROWS_NUMBERED)
                for i, (name, own, times) in enumerate(fields):
                    row, place, number = numbered_grams(batch.column(own), words[i], k, k)
                    kept = np.ones(len(row), bool) if times is None else _often(batch, times, place) > 0
                    if shorter[i] is not None:
                        kept &= np.isin(number & mask, shorter[i]) & np.isin(number >> WORD_BITS, shorter[i])
                    row, place, number = row[kept], place[kept], number[kept]
                    found, rows, places = _merged(number, row, _often(batch, times, place))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(rows, pa.int64()), pa.array(places)],
                                                     ["field", "number", "df", "corpus_count"])

    columns = [c for _, own, times in fields for c in (own, times) if c]
    parts = lists.select(*columns).mapInArrow(run, "field string, number long, df long, corpus_count long")
    return parts.groupBy("field", "number").agg(F.sum("df").alias("df"), F.sum("corpus_count").alias("corpus_count"))


def _named(grams: DataFrame, fields: Sequence[tuple[str, str, str | None]], sent: Broadcast) -> DataFrame:
    """``grams`` with the text of their numbers in ``term``."""
    names = [name for name, _, _ in fields]

    def run(batches):
        words = sent.value[0]
        for batch in batches:
            terms = []
            for name, number in zip(batch.column("field").to_pylist(), batch.column("number").to_pylist()):
                parts = [(number >> (WORD_BITS * j)) & ((1 << WORD_BITS) - 1) for j in range(PACKED)]
                terms.append("_".join(words[names.index(name)][x - 1].as_py() for x in parts if x))
            yield pa.RecordBatch.from_arrays([batch.column("field"), pa.array(terms, pa.string()), batch.column("df"), batch.column("corpus_count")],
                                             ["field", "term", "df", "corpus_count"])

    return grams.select("field", "number", "df", "corpus_count").mapInArrow(run, "field string, term string, df long, corpus_count long")


def frequent_vocabulary(lists: DataFrame, fields: Sequence[tuple[str, str, str | None]], n: int, n_docs: Column, max_df: float,
                        max_features: int) -> DataFrame:
    """What :func:`field_vocabulary` finds for the 1..n-grams of written token lists, one row of ``lists`` per document.

    A gram is at most as frequent as any gram in it, and the ``max_features``-th most frequent shorter gram bounds the last place of the
    vocabulary. So words are counted first, then pairs of words that reach that bound, then longer grams of such pairs; the result is the same.
    Grams are counted as numbers, or as texts where words hold ``_`` and so may be equal to grams of others.
    Times, if any, must be those of a list that was written out (as of :func:`repeated`), or grams could be more frequent than their words.
    """
    spark = lists.sparkSession
    names = [name for name, _, _ in fields]
    words = durable(word_counts(lists, fields))
    plain = n <= PACKED and words.filter(F.contains("term", F.lit("_"))).isEmpty()
    spent = []
    if not plain:
        words = durable(term_counts(lists, fields, [_atoms] * len(fields)))
    fit = F.col("df") <= max_df * F.col("n_docs")
    whole = words.filter(~F.startswith("term", F.lit(" "))).withColumn("n_docs", n_docs).filter(fit)
    atoms = words.groupBy("field", F.ltrim("term").alias("term")).agg(F.sum("corpus_count").alias("corpus_count"))

    def bounds(counts: DataFrame) -> list[int]:
        """The ``max_features``-th greatest count per field, or 0."""
        last = [counts.filter(F.col("field") == x).orderBy(F.desc("corpus_count")).offset(max_features - 1).limit(1).collect() for x in names]
        return [x[0]["corpus_count"] if x else 0 for x in last]

    def reaching(counts: DataFrame, column: str, floors: list[int]) -> list[list] | None:
        """Values of ``column`` per field that reach its floor, unless they are too many to be sent."""
        some = F.lit(False)
        for name, floor in zip(names, floors):
            some |= (F.col("field") == name) & (F.col("corpus_count") >= floor)
        rows = counts.filter(some).select("field", column).limit(TERMS_AT_ONCE + 1).collect()
        out: dict[str, list] = {name: [] for name in names}
        for name, value in rows:
            out[name].append(value)
        return [sorted(out[name]) for name in names] if len(rows) <= TERMS_AT_ONCE else None

    floors = bounds(whole)
    known = reaching(atoms, "term", floors)
    if known is None:
        counts = term_counts(lists, fields, [word_grams(n)] * len(fields))
    elif not plain:
        counts = term_counts(lists, fields, [partial(known_grams, n)] * len(fields), spark.sparkContext.broadcast([frozenset(x) for x in known]))
    else:
        counts, shorter = words, [None] * len(fields)
        arrays = [pa.array(x, pa.string()) for x in known]
        for k in range(2, n + 1):
            sent = spark.sparkContext.broadcast((arrays, shorter))
            grams = durable(_gram_counts(lists, fields, k, sent))
            spent.append(grams)
            high = F.lit(False)
            for name, floor in zip(names, floors):
                high |= (F.col("field") == name) & (F.col("corpus_count") >= floor)
            counts = counts.unionByName(_named(grams.filter(high), fields, sent))
            if k < n:
                counts = durable(counts)
                spent.append(counts)
                floors = bounds(counts.withColumn("n_docs", n_docs).filter(fit))
                found = reaching(grams, "number", floors)
                shorter = [np.array(x, np.int64) for x in found] if found is not None else [None] * len(fields)
    counts = durable(counts.withColumn("n_docs", n_docs).filter(fit), words, *spent)
    out = None
    for name in names:
        one = counts.filter(F.col("field") == name).orderBy(F.desc("corpus_count"), "term").limit(max_features)
        out = one if out is None else out.unionByName(one)
    return last_read(out.select("term", "df", "corpus_count", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), "field"), counts)


def placed_weights(lists: DataFrame, key: str, fields: Sequence[tuple[str, str, str | None]], grams: Callable, vocab: DataFrame,
                   asked: DataFrame | None, sublinear: bool = True, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights of token lists as ``key, _field, _place, raw``, found inside the row, and ``field, term, _place`` of the terms.

    ``vocab(field, term, idf)`` is sent with the tasks. Terms outside ``asked(field, term)`` become one entry of their joint length per
    document and field, at place -1, so lengths stay whole; without ``asked`` every term is there, with its name in ``term``.
    Where ``grams`` counts 1..n-grams, ``words`` says the n, and they are found by number.
    """
    spark = lists.sparkSession
    places = vocab.select("field", "term", "idf")
    if asked is not None:
        places = places.join(asked.select("field", "term").distinct().withColumn("_asked", F.lit(True)), ["field", "term"], "left")
    else:
        places = places.withColumn("_asked", F.lit(True))
    rows = sorted(places.collect())
    numbers = [{} for _ in fields]
    names = [name for name, _, _ in fields]
    for i, r in enumerate(rows):
        numbers[names.index(r["field"])][r["term"]] = i
    idf = np.array([r["idf"] for r in rows], np.float64)
    place = np.array([i if r["_asked"] else -1 for i, r in enumerate(rows)], np.int64)
    sent = spark.sparkContext.broadcast((numbers, idf, place, [r["term"] for r in rows] if asked is None else None))
    named = asked is None

    def counted_one_by_one(batch, f, own, times):
        numbers, row, number, tf = sent.value[0], [], [], []
        for i, (t, o) in enumerate(zip(_lists(batch.column(own)), _lists(batch.column(times)) if times else repeat(None))):
            found = {} if t is None else grams(t, o)
            mine = found.keys() & numbers[f].keys()
            row += [i] * len(mine)
            number += map(numbers[f].__getitem__, mine)
            tf += map(found.__getitem__, mine)
        return np.array(row, np.int64), np.array(number, np.int64), np.array(tf, np.float64)

    def run(batches):
        numbers, idf, place, terms = sent.value
        by_number = [Numbered(list(own), words) for own in numbers] if words and words <= PACKED else None
        first = [np.fromiter(own.values(), np.int64, len(own)) for own in numbers]
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                for f, (_, own, times) in enumerate(fields):
                    quick = by_number[f].found(batch.column(own), batch.column(times) if times else None) if by_number else None
                    row, number, tf = (quick[0], first[f][quick[1]], quick[2]) if quick else counted_one_by_one(batch, f, own, times)
                    raw = ((1 + np.log(tf)) if sublinear else tf) * idf[number]
                    kept = place[number] >= 0
                    rest = np.sqrt(np.bincount(row[~kept], raw[~kept] ** 2, batch.num_rows))
                    others = np.flatnonzero(rest)
                    out = [batch.column(key).take(pa.array(np.concatenate([row[kept], others]))), pa.array(np.full(kept.sum() + len(others), f), pa.int32()),
                           pa.array(np.concatenate([place[number[kept]], np.full(len(others), -1)])), pa.array(np.concatenate([raw[kept], rest[others]]))]
                    if named:
                        out.append(pa.array([terms[i] for i in number], pa.string()))
                    yield pa.RecordBatch.from_arrays(out, [key, "_field", "_place", "raw", *["term"] * named])

    shape = f"{key} {lists.schema[key].dataType.simpleString()}, _field int, _place long, raw double" + ", term string" * named
    columns = [c for _, own, times in fields for c in (own, times) if c]
    shown = spark.createDataFrame([(r["field"], r["term"], i) for i, r in enumerate(rows)], "field string, term string, _place long")
    return lists.select(key, *columns).mapInArrow(run, shape), shown


def raw_weights(terms: DataFrame, key: str, vocab: DataFrame, sublinear: bool = True, fields: Sequence[str] = (),
                term_fields: Sequence[str] | None = None) -> DataFrame:
    """``(key, *fields, term, raw)``: damped counts times idf, before norming.

    ``term_fields`` names the field columns the term table has; terms without
    fields (queries) are weighted for every field.
    """
    on = [*(fields if term_fields is None else term_fields), "term"]
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    return terms.join(vocab.select(*fields, "term", "idf"), on).select(key, *fields, "term", (tf * F.col("idf")).alias("raw"))


def tfidf(terms: DataFrame, key: str, vocab: DataFrame, **kw) -> DataFrame:
    """Unit-length ``(key, *fields, term, weight)`` rows over the vocabulary."""
    raw = raw_weights(terms, key, vocab, **kw)
    part = [key, *kw.get("fields", ())]
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*part)))
    return raw.select(*part, "term", (F.col("raw") / norm).alias("weight"))


#: Weights of documents in a block, queries in a block, and documents whose scores are held at once (more where long lists are asked for).
WEIGHTS_PER_BLOCK, QUERIES_PER_BLOCK, DOCS_AT_ONCE = 500_000, 2000, 256


def _prepared(doc: np.ndarray, field: np.ndarray, place: np.ndarray, raw: np.ndarray, query: np.ndarray, asked: np.ndarray, qw: np.ndarray, norm: bool) -> tuple:
    """Weights of a block's documents (ascending) at the places asked for, and the queries by place."""
    weight = raw
    if norm and len(raw):
        unit = field.astype(np.int64)
        unit += doc * (int(unit.max()) + 1)
        weight = weight / np.sqrt(np.bincount(unit, weight * weight))[unit]
    order = np.argsort(asked, kind="stable")
    places, starts = np.unique(asked[order], return_index=True)
    starts = np.append(starts, len(order))
    hit = np.flatnonzero(np.isin(place, places))  # below zero: no query has the term
    return np.searchsorted(places, place[hit]), doc[hit], weight[hit], starts, query[order], qw[order]


def _sums(prepared: tuple, low: int, step: int, n_q: int) -> np.ndarray:
    """Scores of ``step`` documents from ``low`` on with all queries."""
    at, doc, weight, starts, query, qw = prepared
    some = slice(*np.searchsorted(doc, (low, low + step)))
    first, sizes = starts[at[some]], starts[at[some] + 1] - starts[at[some]]
    take = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    cell = query[take] * step + np.repeat(doc[some] - low, sizes)
    sums = np.bincount(cell, qw[take] * np.repeat(weight[some], sizes), n_q * step)
    return sums.astype(float, copy=False).reshape(n_q, step)  # counts of nothing are whole numbers


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    coded = column.combine_chunks().dictionary_encode("encode")
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _matched(key: str, query_key: str, name: str, most: int | None, least: float, norm: bool = True):
    """Scores of a block of documents ``(key, _field, _place, raw)`` with a block of queries ``(query_key, _place, qw)``."""
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({query_key: asked.column(f"{query_key}_").slice(0, 0), key: docs.column(key).slice(0, 0), name: pa.array([], pa.float64())})
        if not len(docs) or not len(asked):
            return empty
        docs = docs.sort_by([(key, "ascending"), ("_place", "ascending")])  # equal scores go to the smaller key
        (ids, doc), (qids, query) = _coded(docs.column(key)), _coded(asked.column(f"{query_key}_"))
        prepared = _prepared(doc, docs.column("_field").to_numpy(), docs.column("_place").to_numpy(), docs.column("raw").to_numpy(),
                             query, asked.column("_place_").to_numpy(), asked.column("qw_").to_numpy(), norm)
        out, step = [], max(DOCS_AT_ONCE, 4 * (most or 0))
        for low in range(0, len(ids), step):
            scores = _sums(prepared, low, step, len(qids))
            rows, columns = best_places(scores, most) if most else np.nonzero(scores)
            kept = (scores[rows, columns] > 0) & (scores[rows, columns] >= least)
            rows, columns = rows[kept], columns[kept]
            out.append(pa.table({query_key: qids.take(pa.array(rows)), key: ids.take(pa.array(columns + low)),
                                 name: pa.array(scores[rows, columns])}))
        return pa.concat_tables([empty, *out])

    return run


@dataclass
class Channel:
    """Weights of documents ``(key, _field, _place, raw)`` and of queries ``(query_key, _place, qw)``, as :func:`match_places` takes them.

    A pair without a score in a channel that ``finds`` is not returned.
    """

    docs: DataFrame
    asked: DataFrame
    norm: bool = True
    finds: bool = True


#: Pairs of documents and queries that a block holds at most where all are returned.
PAIRS_PER_BLOCK = 4_000_000


def _joined_channels(key: str, query_key: str, channels: Sequence[tuple[str, bool, bool]], doc_names: Sequence[str], query_names: Sequence[str],
                     finish: Callable, names: Sequence[str], most: int | None, rank: Callable | None):
    def values(codes, wanted, own, values, n):
        out = np.zeros(n)
        out[own[codes == wanted]] = values[codes == wanted]
        return out

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({query_key: asked.column(f"{query_key}_").slice(0, 0), key: docs.column(key).slice(0, 0)} | {c: pa.array([], pa.float64()) for c in names})
        if not len(docs) or not len(asked):
            return empty
        docs = docs.sort_by([(key, "ascending"), ("_place", "ascending")])
        (ids, doc), (qids, query) = _coded(docs.column(key)), _coded(asked.column(f"{query_key}_"))
        field, place, raw, kind = (docs.column(c).to_numpy() for c in ("_field", "_place", "raw", "_kind"))
        q_place, qw, q_kind = (asked.column(c).to_numpy() for c in ("_place_", "qw_", "_kind_"))
        n = len(channels)
        prepared = []
        for i, (_, norm, _) in enumerate(channels):
            mine, theirs = kind == i, q_kind == i
            prepared.append(_prepared(doc[mine], field[mine], place[mine], raw[mine], query[theirs], q_place[theirs], qw[theirs], norm))
        of_docs = {c: values(kind, n + i, doc, raw, len(ids)) for i, c in enumerate(doc_names)}
        of_queries = {c: values(q_kind, n + i, query, qw, len(qids))[:, None] for i, c in enumerate(query_names)}
        out, step = [empty], max(DOCS_AT_ONCE, 4 * (most or 0))
        for low in range(0, len(ids), step):
            wide = min(step, len(ids) - low)
            sums = {c: _sums(own, low, step, len(qids))[:, :wide] for (c, _, _), own in zip(channels, prepared)}
            here = {c: v[None, low:low + wide] for c, v in of_docs.items()}
            found = np.logical_or.reduce([sums[c] > 0 for c, _, finds in channels if finds]) & (here["shown"] > 0)
            scores = finish(sums, here, of_queries)
            if most:
                rows, columns = best_places(np.where(found, rank(scores), -np.inf), most)
                kept = found[rows, columns]
                rows, columns = rows[kept], columns[kept]
            else:
                rows, columns = np.nonzero(found)
            out.append(pa.table({query_key: qids.take(pa.array(rows)), key: ids.take(pa.array(columns + low))} | {c: pa.array(scores[c][rows, columns]) for c in names}))
        return pa.concat_tables(out)

    return run


def match_channels(channels: Mapping[str, Channel], key: str, query_key: str, doc_values: DataFrame, query_values: DataFrame, finish: Callable,
                   names: Sequence[str], most: int | None = None, rank: Callable | None = None) -> DataFrame:
    """``query_key, key, *names`` of the pairs that some channel finds, each once: all channels are added up in the same blocks, so no tables of pairs are joined.

    ``doc_values(key, shown, ...)`` and ``query_values(query_key, ...)`` hold numbers of each (null counts as 0, one row per key counts); documents
    whose ``shown`` is not above 0 are left out. ``finish(sums, of_docs, of_queries)`` makes the columns ``names`` out of arrays of queries by
    documents; with ``most`` only the best of a query and block by ``rank(columns)`` leave a task.
    """
    spark = doc_values.sparkSession
    kind = lambda i: F.lit(i).alias("_kind")
    doc_names, query_names = ([c for c in df.columns if c != own] for df, own in ((doc_values, key), (query_values, query_key)))
    parts = [c.docs.select(key, F.col("_field").cast("int").alias("_field"), F.col("_place").cast("bigint").alias("_place"), "raw", kind(i)) for i, c in enumerate(channels.values())]
    asked = [c.asked.select(query_key, F.col("_place").cast("bigint").alias("_place"), "qw", kind(i)) for i, c in enumerate(channels.values())]
    parts += [doc_values.filter(F.col(c).isNotNull()).select(key, F.lit(0).alias("_field"), F.lit(0).cast("bigint").alias("_place"), F.col(c).cast("double").alias("raw"), kind(len(channels) + i))
              for i, c in enumerate(doc_names)]
    asked += [query_values.filter(F.col(c).isNotNull()).select(query_key, F.lit(0).cast("bigint").alias("_place"), F.col(c).cast("double").alias("qw"), kind(len(channels) + i))
              for i, c in enumerate(query_names)]
    docs = durable(reduce(DataFrame.unionByName, parts).filter(F.col(key).isNotNull()))
    asked = durable(reduce(DataFrame.unionByName, asked))
    total, n_queries = docs.count(), asked.select(query_key).distinct().count()
    n_d = max(1, math.ceil(total / WEIGHTS_PER_BLOCK), min(spark.sparkContext.defaultParallelism, math.ceil(total / 20_000)))
    if not most:
        n_d = max(n_d, math.ceil(docs.filter(F.col("_kind") == len(channels)).count() * min(n_queries, QUERIES_PER_BLOCK) / PAIRS_PER_BLOCK))
    n_q = max(1, math.ceil(n_queries / QUERIES_PER_BLOCK))
    run = _joined_channels(key, query_key, [(c, x.norm, x.finds) for c, x in channels.items()], doc_names, query_names, finish, names, most, rank)
    shape = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in ((query_key, asked), (key, docs))) + "".join(f", {c} double" for c in names)
    return last_read(_meeting_blocks(docs, asked, key, query_key, ["_field", "_place", "raw", "_kind"], ["_place", "qw", "_kind"], n_d, n_q).applyInArrow(run, shape), docs, asked)


def _meeting_blocks(docs: DataFrame, asked: DataFrame, key: str, query_key: str, doc_columns: Sequence[str], asked_columns: Sequence[str], n_d: int, n_q: int):
    """Every one of ``n_d`` blocks of documents beside every one of ``n_q`` blocks of queries, whose columns end in ``_``."""
    left = docs.select(key, *doc_columns, F.pmod(F.xxhash64(key), F.lit(n_d)).cast("int").alias("_d"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("_q"))
    right = asked.select(F.col(query_key).alias(f"{query_key}_"), *[F.col(c).alias(f"{c}_") for c in asked_columns],
                         F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("_d_"), F.pmod(F.xxhash64(query_key), F.lit(n_q)).cast("int").alias("_q_"))
    # As many tasks as pairs of blocks, so that a task sorts about one, however large the tables are.
    left, right = left.repartition(n_d * n_q, "_d", "_q"), right.repartition(n_d * n_q, "_d_", "_q_")
    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d_", "_q_"))


def by_place(raw: DataFrame, key: str, queries: DataFrame, fields: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Weighted terms of documents and queries ``(query_key, *fields, term, qw)``, both written before, as :func:`match_places` takes them."""
    on = [*fields, "term"]
    places = durable(number_rows(queries.select(*on).distinct(), [F.col(c) for c in on], "_place"))
    field = F.lit(0)
    if fields:
        names = sorted(r[0] for r in queries.select(*fields).distinct().collect())  # the few fields of an item
        field = F.coalesce(*[F.when(F.col(fields[0]) == x, F.lit(i)) for i, x in enumerate(names)], F.lit(len(names)))
    placed = raw.filter(F.col(key).isNotNull()).join(places, on, "left").select(
        key, field.cast("int").alias("_field"), F.coalesce("_place", F.lit(-1)).cast("bigint").alias("_place"), "raw")
    return placed, queries.join(places, on)


def match_weights(raw: DataFrame, key: str, queries: DataFrame, query_key: str, fields: Sequence[str] = (),
                  name: str = "score", most: int | None = None, least: float = 0.0) -> DataFrame:
    """Cosines of documents with weighted queries ``(query_key, *fields, term, qw)``, both written before.

    Blocks of documents meet blocks of queries, and a task adds the scores of a few documents up at once, so no table of pairs is
    shuffled or summed. With ``most`` only rows that can be among the best ``most`` of a query are sure to be returned, scores
    below ``least`` are not.
    """
    placed, asked = by_place(raw, key, queries, fields)
    return match_places(placed, key, asked, query_key, name, most, least, total=raw.count())


def match_places(placed: DataFrame, key: str, queries: DataFrame, query_key: str, name: str = "score", most: int | None = None,
                 least: float = 0.0, norm: bool = True, total: int | None = None) -> DataFrame:
    """:func:`match_weights` of documents ``(key, _field, _place, raw)`` with queries ``(query_key, _place, qw)``.

    Without ``norm`` weights count as they are.
    """
    spark = placed.sparkSession
    total = placed.count() if total is None else total
    n_d = max(1, math.ceil(total / WEIGHTS_PER_BLOCK), min(spark.sparkContext.defaultParallelism, math.ceil(total / 20_000)))
    n_q = max(1, math.ceil(queries.select(query_key).distinct().count() / QUERIES_PER_BLOCK))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((placed, key), (queries, query_key))}
    asked = queries.withColumn("_place", F.col("_place").cast("bigint"))
    return _meeting_blocks(placed, asked, key, query_key, ["_field", "_place", "raw"], ["_place", "qw"], n_d, n_q).applyInArrow(
        _matched(key, query_key, name, most, least, norm), f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, {name} double")


def cosine(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, name: str = "score") -> DataFrame:
    """Dot products of unit vectors for all pairs that share a term."""
    q = queries.select(query_key, "term", F.col("weight").alias("_qw"))
    return (docs.join(q, "term").groupBy(query_key, doc_key)
            .agg(F.sum(F.col("weight") * F.col("_qw")).alias(name)))


#: How often a token of a part counts in the field.
PART_TIMES = {"title": 6, "topics": 5, "category": 4, "description": 2, "type": 2}


def field_parts(title: Column, topics: Column, category: Column, description: Column, kind: Column,
                stop: Sequence[str] = tx.STOP_WORDS) -> dict[str, Column]:
    """Tokens of every part of a catalog item. Multi-word topics, categories and types are glued into one token."""
    def glued(text: Column) -> Column:
        return tx.words(F.replace(text, F.lit(" "), F.lit("")))

    # Topics are an array of normal forms; each becomes one glued word.
    words = {"title": tx.words(title), "topics": F.flatten(F.transform(topics, glued)), "category": glued(category),
             "description": tx.words(description), "type": glued(kind)}
    return {name: tx.drop_words(tokens, stop, 2) for name, tokens in words.items()}


def repeated(tokens: Column, times: int) -> tuple[Column, Column]:
    """``tokens`` written ``times`` times, with nothing repeated: a shorter array and how often its places count.

    N-grams (up to three tokens) that start at a place and are counted so often are those of the full array. The last two
    tokens come once more than they are followed by the first two; those first two only show what follows. Arrays of one token are
    repeated as they are.
    """
    size = F.size(tokens)
    short = F.array_repeat(F.get(tokens, F.lit(0)), times)
    if times == 1:
        return tokens, F.array_repeat(F.lit(1), size)
    tail = F.slice(tokens, F.greatest(size - 1, F.lit(1)), F.lit(2))
    long = F.concat(tokens, F.slice(tokens, 1, 2), tail)
    counts = F.concat(F.array_repeat(F.lit(times), size - 2), F.array_repeat(F.lit(times - 1), F.lit(2)), F.array(*map(F.lit, (0, 0, 1, 1))))
    none = F.array()
    return (F.when(size >= 2, long).when(size == 1, short).otherwise(none.cast("array<string>")),
            F.when(size >= 2, counts).when(size == 1, F.array_repeat(F.lit(1), times)).otherwise(none.cast("array<int>")))


def _asked_rows(arrays: DataFrame, key: str, n: int, sent: Broadcast) -> DataFrame:
    """``key, term, tf, dl`` of the sent terms in token lists ``_toks``; a row without a term carries the number of all 1..n-grams."""
    def run(batches):
        terms, grams = sent.value, word_grams(n)
        numbered = Numbered(terms, n) if n <= PACKED else None
        at, texts = {t: i for i, t in enumerate(terms)}, pa.array(terms, pa.string())
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                tokens = batch.column("_toks")
                sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                dl = sum(np.maximum(sizes - k, 0) for k in range(n))
                quick = numbered.found(tokens, None) if numbered else None
                if quick is None:
                    found = [(i, at[g], tf) for i, t in enumerate(_lists(tokens)) for g, tf in (grams(t, None).items() if t else ()) if g in at]
                    quick = [np.array([x[j] for x in found], np.int64) for j in range(3)]
                row = np.concatenate([np.arange(batch.num_rows), quick[0]])
                term = pa.concat_arrays([pa.nulls(batch.num_rows, pa.string()), texts.take(pa.array(quick[1]))])
                tf = np.concatenate([np.zeros(batch.num_rows, np.int64), quick[2].astype(np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), term, pa.array(tf), pa.array(dl[row])], [key, "term", "tf", "dl"])

    return arrays.select(key, "_toks").mapInArrow(run, f"{key} {arrays.schema[key].dataType.simpleString()}, term string, tf long, dl long")


def bm25(docs: DataFrame, doc_key: str, tokens: Column, queries: DataFrame, query_key: str, query_tokens: Column,
         k1: float = 1.4, b: float = 0.75, ngrams: int = 3, name: str = "bm25") -> DataFrame:
    """BM25 of every query-document pair that shares a term (see :func:`bm25_channel`)."""
    own = bm25_channel(docs, doc_key, tokens, queries, query_key, query_tokens, k1, b, ngrams)
    return match_places(own.docs, doc_key, own.asked, query_key, name, norm=False)


def bm25_channel(docs: DataFrame, doc_key: str, tokens: Column, queries: DataFrame, query_key: str, query_tokens: Column,
                 k1: float = 1.4, b: float = 0.75, ngrams: int = 3) -> Channel:
    """BM25 weights of documents, with queries whose terms count once.

    Texts are tokenised once. Only terms of the queries leave a document (they are sent with the tasks, or joined if they
    are too many), so the written posting table has the size of the matches; a row without a term
    carries the length of each document. Scores are added up in blocks of documents.
    """
    spark = docs.sparkSession
    q = durable(doc_terms(queries, query_key, query_tokens, ngrams).select(query_key, "term"))
    wanted = durable(number_rows(q.select("term").distinct(), [F.col("term")], "_place"))
    arrays = dealt(docs, doc_key).select(doc_key, tokens.alias("_toks"))
    some = wanted.select("term").limit(TERMS_AT_ONCE + 1).collect()
    if len(some) <= TERMS_AT_ONCE:
        rows = _asked_rows(arrays, doc_key, ngrams, spark.sparkContext.broadcast(sorted(r[0] for r in some)))
    else:
        rows = gram_rows(arrays, doc_key, [(None, "_toks", None)], word_grams(ngrams), total=True).withColumnRenamed("size", "dl")
        rows = rows.join(wanted.select("term", F.lit(True).alias("_hit")), "term", "left").filter(F.col("term").isNull() | F.col("_hit"))
    index = durable(rows.select(doc_key, "term", "dl", "tf"))
    lengths = index.filter("term IS NULL")
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).alias("v")).scalar()
    postings = index.filter("term IS NOT NULL")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_s", stats)
    idf = df.select("term", "_s.avgdl", F.log(1 + (F.col("_s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = (F.col("idf") * F.col("tf") * (k1 + 1)
            / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    weighted = postings.join(idf, "term").join(wanted, "term").select(
        doc_key, F.lit(0).alias("_field"), F.col("_place").cast("bigint").alias("_place"), part.alias("raw"))
    return Channel(durable(weighted, index), q.join(wanted, "term").withColumn("qw", F.lit(1.0)), norm=False)


def min_max(scores: DataFrame, query_key: str, name: str, n_docs: Column) -> DataFrame:
    """Scale each query's scores to [0, 1]; unmatched documents count as 0, all-equal becomes 0."""
    scores = durable(scores)
    ends = score_ends(scores, query_key, name, n_docs)
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(name) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return scores.join(ends, query_key).withColumn(name, scaled).drop("_lo", "_hi")


def score_ends(scores: DataFrame, query_key: str, name: str, n_docs: Column) -> DataFrame:
    """``query_key, _lo, _hi``: least and greatest score of a query; unmatched documents count as 0."""
    ends = scores.groupBy(query_key).agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"),
                                         F.count(F.lit(1)).alias("_n"))
    return ends.withColumn("_lo", F.when(F.col("_n") < n_docs, F.least(F.lit(0.0), F.col("_lo"))).otherwise(F.col("_lo"))).drop("_n")


def substring_hits(queries: DataFrame, query_key: str, query_tokens: Column, docs: DataFrame, doc_key: str,
                   text: Column, name: str) -> DataFrame:
    """Share of a query's distinct tokens that occur inside the document text.

    A token never holds a space, so it can only occur inside one word. The
    distinct words of the texts are cut into substrings and joined by equality
    with the distinct query tokens; documents join by whole word afterwards.
    """
    q = queries.select(query_key, F.explode(F.array_distinct(query_tokens)).alias("token"))
    sizes = q.groupBy(query_key).agg(F.count(F.lit(1)).alias("_n"))
    return (words_holding(q.select("token").distinct(), docs, doc_key, text).join(q, "token").groupBy(query_key, doc_key)
            .agg(F.countDistinct("token").alias("_hits")).join(sizes, query_key)
            .select(query_key, doc_key, (F.col("_hits") / F.col("_n")).alias(name)))


def words_holding(tokens: DataFrame, docs: DataFrame, doc_key: str, text: Column) -> DataFrame:
    """``doc_key, token`` of the tokens inside each word of a document's text."""
    doc_words = docs.select(doc_key, F.explode(F.array_distinct(tx.words(text))).alias("word"))
    length = F.length("word")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(
        F.sequence(i, F.length("word")), lambda j: F.substring(F.col("word"), i, j - i + 1))))
    inside = (doc_words.select("word").distinct().filter(length >= 1)
              .select("word", F.explode(F.array_distinct(pieces)).alias("token")).join(tokens, "token"))
    return doc_words.join(inside, "word").select(doc_key, "token")


def stem_table(terms: DataFrame, term: str = "term", times: str = "tf") -> DataFrame:
    """``term, stem, n`` of distinct terms with their numbers of occurrences; suffix rules run once per distinct term."""
    return terms.groupBy(F.col(term).alias("term")).agg(F.sum(times).alias("n")).select("term", stem(F.col("term")).alias("stem"), "n")


def stemmed_terms(texts: DataFrame, key: str, text: Column, stop: Sequence[str] = tx.STOP_WORDS) -> DataFrame:
    """``key, stem, tf``: index stems of each text; lengths and stop words are looked at after stemming.

    Words are counted inside the row first, so a text meets the stem table once
    per distinct word, and its stems are added up per key.
    """
    terms = durable(doc_terms(texts, key, tx.words(text)))
    stems = stem_table(terms).select("term", "stem").filter((F.length("stem") > 1) & ~F.col("stem").isin(list(stop)))
    return terms.join(stems, "term").groupBy(key, "stem").agg(F.sum("tf").alias("tf"))
