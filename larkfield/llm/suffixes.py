"""Repeated passages by grouped window hashes, in place of a sparse suffix array.

Suffixes start at words chosen by content: a word is kept when the hash of the ``GRAM`` words from it is the
smallest in a window of neighbours, so equal passages keep the same places. Nothing is sorted or extended:
hashes of the first words of suffixes are grouped, and those that different documents have survive. Then the
hashes of all passages of ``length`` words around a survivor are grouped in the same way.
The order of a run of equal suffixes is by document, so its head is a grouped minimum, and runs of any size are
summed before the shuffle. Any passage of ``length`` words that two documents share holds a kept word, with at
least ``length - window + 1`` shared words from it on, so none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import M1, Scratch, WordHashes, ascii_words, give_back, gram_hashes, mixed

GRAM = 8
LENGTH = 50
WINDOW = 34
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kept_words(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost smallest gram of every window of ``window`` grams."""
    grams = gram_hashes(hashes, GRAM)
    if len(grams) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + views.argmin(axis=1))


def prefix_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, in steps that double the hashed length."""
    out, length = hashes, 1
    while length < n:
        step = min(length, n - length)
        size = len(out) - step
        if size <= 0:
            return np.empty(0, np.uint64)
        out = joined(out[:size], out[step:step + size], length + step)
        length += step
    return out


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mixed(a * M1 + mixed(b + np.uint64(salt)))


def _suffixes(length: int, window: int):
    """One row per kept word: hash of the words that a shared passage must hold from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = WordHashes()
        for batch in batches:
            rows, keys = [], []
            for row, text in enumerate(batch.column(1)):
                hashes = words.of(ascii_words(text.as_py()))
                if len(hashes) < length:
                    continue
                firsts = prefix_hashes(hashes, length - window + 1)
                kept = kept_words(hashes, window)
                own = np.unique(firsts[kept[kept < len(firsts)]])
                keys.append(own)
                rows.append(np.full(len(own), row))
            take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            all_keys = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(all_keys)], ["doc", "mark", "key"])

    return run


def _passages(length: int, window: int):
    """Rows for the passages of ``length`` words that hold a surviving suffix near their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = WordHashes()
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                hashes = words.of(ascii_words(text.as_py()))
                firsts = prefix_hashes(hashes, length - window + 1)
                whole = prefix_hashes(hashes, length)
                kept = kept_words(hashes, window)
                kept = kept[kept < len(firsts)]
                known = np.frombuffer(np.array(batch.column(3)[row].as_py(), np.int64).tobytes(), np.uint64)
                kept = kept[np.isin(firsts[kept], known)]
                starts = np.unique((kept[:, None] - np.arange(window)).ravel())
                starts = starts[(starts >= 0) & (starts < len(whole))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(np.full(len(starts), row))) for i in (0, 2)), pa.array(whole[starts].view(np.int64)),
                     pa.array(starts.astype(np.int32))], ["doc", "mark", "key", "start"])

    return run


def runs_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Word spans covered by passages of ``length`` words at the given starts."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(g[0]), int(g[-1]) + length) for g in np.split(starts, breaks)]


def _spans(length: int):
    """Spans of a text in words and in bytes of its UTF-8 form, and the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rests = [], []
            for text, starts in zip(batch.column(1), batch.column(2)):
                raw = text.as_py() or ""
                runs = runs_of(np.array(starts.as_py() or [], np.int64), length)
                if not runs:
                    spans.append([])
                    rests.append(raw)
                    continue
                data = raw.encode("utf-8")
                at = [m.span() for m in _WORD.finditer(data)]
                spans.append([{"first_word": a, "last_word": b - 1, "start": len(data[:at[a][0]].decode("utf-8")),
                               "end": len(data[:at[b - 1][1]].decode("utf-8"))} for a, b in runs])
                rest, before = [], 0
                for a, b in runs:
                    rest.append(data[before:at[a][0]])
                    before = at[b - 1][1]
                rests.append(b"".join([*rest, data[before:]]).decode("utf-8").strip())
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(rests, pa.string())],
                                             ["doc", "text", "spans", "rest"])

    return run


def _repeated_starts(docs: DataFrame, id_col: str, text_col: str, length: int, window: int) -> tuple[DataFrame, DataFrame]:
    """``doc, text`` of rows with an id, and ``doc, mark, starts, heads``: first words of repeated passages, and their keepers.

    ``mark`` tells apart the texts of rows that repeat an id.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"),
                                                       F.xxhash64(text_col).alias("mark"))
    kind = texts.schema["doc"].dataType.simpleString()
    suffixes = scratch.keep(texts.mapInArrow(_suffixes(length, window), f"doc {kind}, mark long, key long"), "suffixes")
    shared = suffixes.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key")
    known = scratch.keep(suffixes.join(shared, "key").groupBy("doc", "mark").agg(F.collect_set("key").alias("keys")), "known")  # a text's own
    passages = scratch.keep(texts.join(known, ["doc", "mark"]).select("doc", "text", "mark", "keys").mapInArrow(
        _passages(length, window), f"doc {kind}, mark long, key long, start int"), "passages")
    scratch.drop("suffixes", "known")
    heads = passages.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head < last").select("key", "head")
    starts = scratch.keep(passages.join(heads, "key").where("doc > head").groupBy("doc", "mark").agg(
        F.collect_set("start").alias("starts"), F.sort_array(F.collect_set("head")).alias("heads")), "starts")
    scratch.drop("passages")
    return texts, starts


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                      window: int = WINDOW) -> DataFrame:
    """``<id>, text, spans, rest, kept_in`` of the documents that repeat passages of documents with smaller ids.

    A span covers every passage of at least ``length`` words (between ASCII blanks, A-Z read as a-z) that the document
    with the smallest id among its holders keeps and this one repeats; ``rest`` is the text without
    its spans and ``kept_in`` lists the documents that keep them. Null ids, null and short texts repeat nothing. Rows
    that repeat an id count as one document and don't repeat each other; they get one row each. Other columns
    are ignored.
    """
    texts, starts = _repeated_starts(docs, id_col, text_col, length, window)
    kind = texts.schema["doc"].dataType.simpleString()
    spans = _spans(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in spans(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(3)], [*out.schema.names, "kept_in"])

    shape = (f"doc {kind}, text string, spans array<struct<first_word: int, last_word: int, start: int, end: int>>, rest string, "
             f"kept_in array<{kind}>")
    return texts.join(starts, ["doc", "mark"]).select("doc", "text", "starts", "heads").mapInArrow(run, shape).withColumnRenamed("doc", id_col)


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``docs`` with the spans of ``repeated_passages`` cut from the texts; all rows and other columns stay as they are."""
    _, starts = _repeated_starts(docs, id_col, text_col, length, window)
    place, kinds = docs.columns.index(text_col), ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    spans = _spans(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            own = pa.RecordBatch.from_arrays([texts, texts, batch.column(batch.num_columns - 1)], ["doc", "text", "starts"])
            rest = next(spans(iter([own]))).column(3)
            columns = [pa.compute.if_else(pa.compute.is_valid(texts), rest, None) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    taken = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any name of the input
    found = starts.select(F.col("doc").alias(f"{taken}id"), F.col("mark").alias(f"{taken}mark"), F.col("starts").alias(f"{taken}starts"))
    same = (docs[id_col] == found[f"{taken}id"]) & (F.xxhash64(docs[text_col]) == found[f"{taken}mark"])
    joined = docs.join(found, same, "left").drop(f"{taken}id", f"{taken}mark")
    return joined.mapInArrow(run, kinds)
