"""Ranked lexical search: whole-number term scores, norm buckets, exact top k.

A document is a vector of impacts (weight times damped count) over the terms of the items; other terms can't score.
Vectors are ordered by length (range partitions, longest first) and walked in buckets of ``BUCKET`` vectors. For an item and a bucket:

1. Cauchy-Schwarz: an item of n terms scores at most sqrt(n) times the bucket's longest vector. When that is below the item's
   k-th best score, the item passes over the bucket.
2. Coordinate bounds: the sum of the bucket's greatest impacts per coordinate; then, after adding up the item's ``FOCUS`` heaviest
   coordinates, what is left of a vector scores at most the smaller of its remaining length times the item's remaining length,
   and the greatest impacts of the remaining coordinates.
3. Survivors are scored anew from all their coordinates in 64-bit whole numbers.

The k-th best scores start from the longest 1/``HEAD`` of the vectors, searched first. Bounds are widened for
rounding and only strictly lower ones prune, so the result is exact. Items are taken in blocks of bounded size; each
block reads the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch
from larkfield.operators.ranking import top_per_group

#: ASCII letters and digits stay (A-Z in lower case), other ASCII parts words; bytes over 7F are parts of letters.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
SCALE, DAMPING = 1_000_000_000, 1000
BUCKET, FOCUS, HEAD = 8192, 8, 64
BLOCK_ITEMS, BLOCK_TERMS = 4096, 100_000
_SLACK = 1 + 1e-9


def words_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return (text or b"").translate(FOLD).split()


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the ends of its rows, from 0."""
    ends = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[ends[0]:ends[-1]] if len(ends) else np.empty(0, np.int64), ends - ends[:1]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _counted(terms: list[bytes]):
    packed = b" ".join(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = {w: i for i, w in enumerate(packed.split())}.get
        for batch in batches:
            sizes, held, counts, ends = [], [], [], [0]
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = Counter(map(slot, words))
                found.pop(None, None)
                sizes.append(len(words))
                held.extend(found)
                counts.extend(found.values())
                ends.append(len(held))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _lists(np.array(held, np.int32), ends), _lists(np.array(counts, np.int64), ends)],
                ["doc", "size", "terms", "counts"])

    return run


def _frequencies(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["term", "df"])

    return run


def impact(weight: np.ndarray, count: np.ndarray, size: np.ndarray, n_docs: int, n_words: int, b: int = 90) -> np.ndarray:
    """``weight * (SCALE * count div (DAMPING * count + 8 * m))`` with ``m = 100 - b + (b * size * n_docs) div n_words``."""
    if len(size) and b * int(size.max()) * n_docs >= 1 << 63:  # beyond 64 bits: whole numbers of any size
        m = np.array([100 - b + b * int(s) * n_docs // n_words for s in size], np.int64)
    else:
        m = 100 - b + b * size * n_docs // max(n_words, 1)
    return weight * (SCALE * count // (DAMPING * count + 8 * m))


def _vectors(weights: np.ndarray, n_docs: int, n_words: int, b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ends = _flat(batch.column(2))
            counts, _ = _flat(batch.column(3))
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            size = np.asarray(batch.column(1))
            values = impact(weights[terms], counts, size[row], n_docs, n_words, b)
            norms = np.sqrt(np.bincount(row, values.astype(float) ** 2, len(batch)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms), batch.column(2), _lists(values.astype(np.int64), ends)],
                                             ["doc", "norm", "terms", "impacts"])
            yield out.filter(pa.array(norms > 0))

    return run


class Best:
    """The ``k`` best (score, id) of an item so far; ``floor`` is what a new score must reach."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, max(floor, 1), []

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        if len(scores) > self.k:  # keep all that tie with the k-th
            keep = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids = scores[keep], ids.take(pa.array(keep))
        self.rows += zip(scores.tolist(), ids.to_pylist())
        self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[-1][0])


class Bucket:
    """Impact vectors by document and by term."""

    def __init__(self, ids: pa.Array, norms: np.ndarray, terms: np.ndarray, values: np.ndarray, ends: np.ndarray, n_terms: int):
        self.ids, self.norms, self.terms, self.values, self.ends = ids, norms, terms, values, ends
        order = np.argsort(terms, kind="stable")
        self.by_row = np.repeat(np.arange(len(norms)), np.diff(ends))[order]
        self.by_value = values[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.greatest = np.zeros(n_terms, np.int64)
        np.maximum.at(self.greatest, terms, values)

    def search(self, item: np.ndarray, wanted: np.ndarray, best: Best) -> None:
        """Add this bucket's documents to ``best``; ``item`` holds the item's terms, heaviest first, ``wanted`` is a
        scratch mask of all terms."""
        caps = self.greatest[item]
        if int(caps.sum()) < best.floor:
            return
        focus, rest = item[:FOCUS], item[FOCUS:]
        known, left = np.zeros(len(self.norms), np.int64), self.norms ** 2
        for term in focus:
            at = slice(self.starts[term], self.starts[term + 1])
            known[self.by_row[at]] += self.by_value[at]
            left[self.by_row[at]] -= self.by_value[at].astype(float) ** 2
        beyond = np.sqrt(len(rest) * (np.maximum(left, 0) + 1e-12 * self.norms ** 2))
        bound = known + np.minimum(beyond, float(caps[FOCUS:].sum()))
        rows = np.flatnonzero(bound * _SLACK >= best.floor)
        if len(rows) == 0:
            return
        wanted[item] = True
        sizes = self.ends[rows + 1] - self.ends[rows]
        firsts = np.cumsum(sizes) - sizes
        places = np.repeat(self.ends[rows] - firsts, sizes) + np.arange(sizes.sum())
        scores = np.add.reduceat(np.where(wanted[self.terms[places]], self.values[places], 0), firsts)
        wanted[item] = False
        hit = np.flatnonzero(scores >= best.floor)
        if len(hit):
            best.add(scores[hit], self.ids.take(pa.array(rows[hit])))


def _searched(items: list[np.ndarray], floors: list[int], n_terms: int, k: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, reach = [Best(k, floor) for floor in floors], np.sqrt([len(item) for item in items])
        wanted, held, kind = np.zeros(n_terms, bool), [], pa.null()

        def walk() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            norms = table["norm"].to_numpy()
            near = np.flatnonzero(reach * norms.max() * _SLACK >= [b.floor for b in best])
            if len(near):
                terms, ends = _flat(table["terms"].chunk(0))
                one = Bucket(table["doc"].chunk(0), norms, terms, _flat(table["impacts"].chunk(0))[0], ends, n_terms)
                for i in near:
                    one.search(items[i], wanted, best[i])

        for batch in batches:
            kind = batch.schema.field("doc").type
            for low in range(0, len(batch), bucket):
                held.append(batch.slice(low, bucket))
                if sum(map(len, held)) >= bucket:
                    walk()
        if held:
            walk()
        rows = [(i, score, doc) for i, b in enumerate(best) for score, doc in b.rows]
        number, score, doc = list(zip(*rows)) or ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], ["number", "doc", "score"])

    return run


def _blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Items with their distinct terms, in blocks that end after ``most_items`` items or ``most_terms`` distinct terms."""
    ids, own, known = [], [], set()
    for row in items.toLocalIterator():
        ids.append(row[0])
        own.append(sorted(set(words_of(None if row[1] is None else bytes(row[1])))))
        known.update(own[-1])
        if len(ids) >= most_items or len(known) >= most_terms:
            yield ids, own
            ids, own, known = [], [], set()
    if ids:
        yield ids, own


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", b: int = 90, bucket: int = BUCKET, block_items: int = BLOCK_ITEMS,
                  block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``<item>, rank, <doc>, score``: each item's ``k`` documents of the highest score above 0, all if fewer; ties by ascending id.

    Weights use all documents: N with a term, L terms in all, df per term, w = floor(1000 ln((2N + 2) / (2 df + 1))). Null and empty texts
    hold no terms and neither score nor count. Rows that repeat an id are rows of their own, on both sides; a null document id comes before others in
    ties. Empty tables give no rows. Other columns are ignored. ``block_items`` and ``block_terms`` bound what is sent to
    tasks at once; items beyond them are searched in further passes.
    """
    spark = docs.sparkSession
    scratch, out = Scratch(spark), None
    texts = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    item_kind = asked.schema["item"].dataType.simpleString()
    for turn, (ids, own) in enumerate(_blocks(asked, block_items, block_terms)):
        terms = sorted(set().union(*own))
        slot = {w: i for i, w in enumerate(terms)}
        counted = scratch.keep(texts.mapInArrow(_counted(terms), f"doc {kind}, size long, terms array<int>, counts array<long>"), f"counted{turn}")
        n_docs, n_words = counted.agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
        found = counted.select("terms").mapInArrow(_frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        weights = np.zeros(len(terms), np.int64)
        weights[found["term"].to_numpy(np.int64)] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in found["df"]]
        vectors = counted.mapInArrow(_vectors(weights, n_docs, n_words, b), f"doc {kind}, norm double, terms array<int>, impacts array<long>")
        # A row's place parts vectors of one length, such as those of a large group of copies.
        order = [F.col("norm").desc(), F.monotonically_increasing_id()]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = scratch.keep(vectors.repartitionByRange(parts, *order).sortWithinPartitions(F.col("norm").desc()), f"ordered{turn}")
        wanted = [np.array(sorted(map(slot.get, o), key=lambda t: (-weights[t], t)), np.int64) for o in own]
        shape = f"number int, doc {kind}, score long"

        def search(rows: DataFrame, floors: list[int]) -> DataFrame:
            # No sums of small blocks of files: a task walks rows in their written order.
            return rows.mapInArrow(_searched(wanted, floors, len(terms), k, bucket), shape)

        best = [F.col("score").desc(), F.col("doc").asc_nulls_first()]
        cut = (ordered.approxQuantile("norm", [1 - 1 / HEAD], 0.002) or [0.0])[0]
        head = scratch.keep(search(ordered.where(F.col("norm") > cut), [0] * len(ids)), f"head{turn}")
        # A row per item at most.
        full = top_per_group(head, ["number"], best, k).where(F.col("rank") == k).select("number", "score").collect()
        floors = dict(map(tuple, full))
        rest = search(ordered.where(F.col("norm") <= cut), [floors.get(i, 0) for i in range(len(ids))])
        top = top_per_group(head.unionByName(rest), ["number"], best, k)
        names = spark.createDataFrame(list(enumerate(ids)), f"number int, item {item_kind}")
        found = scratch.keep(top.join(names, "number").select("item", "rank", "doc", "score"), f"found{turn}")
        scratch.drop(f"counted{turn}", f"ordered{turn}", f"head{turn}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item {item_kind}, rank int, doc {kind}, score long")
    return out.withColumnsRenamed({"item": item_col, "doc": doc_col})
