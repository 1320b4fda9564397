"""Hard negatives of anchors by the threshold algorithm over per-dimension sorted lists.

Vectors become whole numbers, and rows are dealt evenly over partitions whatever their labels. A task walks its rows in
blocks. A block keeps, per dimension, its rows in order of that component. For an anchor the lists are read from the end that the sign of
the anchor's component prefers, in growing steps of depth (sorted access); every row met for the first time is scored in
whole numbers (random access). The threshold is the score of a row that had the last component read in every list; no
unread row scores higher. An anchor's walk ends once, in every window of scores it fills, the threshold is strictly below the k-th
best score, or below the window. The k-th best of all blocks before are carried along, so later walks end earlier.

Positives are one such search (the rows of the anchor's label, one window without ends), negatives another (the rows of
other labels, a window per positive). Anchors are taken in rounds of bounded size; tasks return k rows per window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch
from larkfield.operators.ranking import top_per_group

BLOCK, ROUND_BYTES = 4096, 32 << 20
FIRST_STEP = 64  # a walk's first step reads one in so many of a list
_NO_END = (None, None)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _exact(values: np.ndarray, dims: int, top: int) -> np.ndarray:
    """``values`` as doubles where their products are exact in them, else as Python's whole numbers."""
    return values.astype(np.float64) if dims * top * top < 1 << 53 else values.astype(object)


class Window:
    """The ``k`` best rows with scores from ``low`` to ``high``, ordered by score, id (none last), mark."""

    def __init__(self, k: int, low: int | None, high: int | None):
        self.k, self.low, self.high = k, low, high
        self.score, self.none, self.id, self.mark = (np.empty(0, t) for t in (np.float64, bool, np.int64, np.int64))

    @property
    def floor(self):
        """What a row must reach to matter."""
        if len(self.score) < self.k:
            return self.low
        return self.score[-1]

    def open(self, threshold) -> bool:
        """Whether rows that score ``threshold`` or less may still come in."""
        floor = self.floor
        return floor is None or threshold >= floor

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> None:
        floor = self.floor
        keep = np.ones(len(score), bool) if floor is None else (score >= floor).astype(bool)
        if self.high is not None:
            keep &= (score <= self.high).astype(bool)
        at = np.flatnonzero(keep)
        if len(at) > self.k and score.dtype != object:  # all that tie with the k-th stay
            at = at[score[at] >= np.partition(score[at], -self.k)[-self.k]]
        if not len(at):
            return
        joined = [np.concatenate(pair) for pair in zip((self.score, self.none, self.id, self.mark), (score[at], none[at], ids[at], mark[at]))]
        if joined[0].dtype == object:
            order = sorted(range(len(joined[0])), key=lambda i: (-joined[0][i], joined[1][i], joined[2][i], joined[3][i]))
        else:
            order = np.lexsort((joined[3], joined[2], joined[1], -joined[0]))
        self.score, self.none, self.id, self.mark = (x[order[:self.k]] for x in joined)


class Lists:
    """A block's rows in order of every component."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, marks: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.none, self.marks, self.labels, self.values = ids, none, marks, labels, values
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(values.T, self.order, 1)

    def walk(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[Window]) -> int:
        """Threshold algorithm of one anchor over the ``wanted`` rows; returns the depth reached."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth, step = np.zeros(n, bool), 0, max(1, n // FIRST_STEP)
        if not len(up) and not len(down):
            depth = n  # every row scores 0; no list to read
            self._score(np.flatnonzero(wanted), anchor, windows)
        while depth < n:
            end = min(n, depth + step)
            now = np.zeros(n, bool)
            now[self.order[up, n - end:n - depth]] = True
            now[self.order[down, depth:end]] = True
            self._score(np.flatnonzero(now & ~met & wanted), anchor, windows)
            met |= now
            depth, step = end, step * 2
            threshold = anchor[up] @ self.sorted[up, n - end] + anchor[down] @ self.sorted[down, end - 1]
            if met.all() or not any(w.open(threshold) for w in windows):
                break
        return depth

    def _score(self, rows: np.ndarray, anchor: np.ndarray, windows: list[Window]) -> None:
        if len(rows):
            score = self.values[rows] @ anchor
            if score.dtype == object:
                score = np.array([min(max(s, _LEAST), _MOST) for s in score], object)
            for w in windows:
                w.add(score, self.none[rows], self.ids[rows], self.marks[rows])


def _column(batch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[name].to_numpy()


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per number of components: row numbers and their components."""
    column = table["parts"].combine_chunks()
    flat, ends = np.asarray(column.values, np.int64), np.asarray(column.offsets, np.int64)
    sizes = np.diff(ends)
    return {int(d): (rows := np.flatnonzero(sizes == d), flat[ends[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def _searched(anchors: pa.Table, windows: list[list[tuple]], same: bool, k: int, block: int):
    """Best rows of every window of every anchor among a task's rows; ``anchors`` has the columns of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [[Window(k, *w) for w in own] for own in windows]
        marks, labels, vectors = _column(anchors, "mark"), _column(anchors, "label"), _matrix(anchors)
        held = []

        def walk() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, none = table["id"].fill_null(0).to_numpy(), table["id"].is_null().to_numpy()
            row_marks, row_labels = _column(table, "mark"), _column(table, "label")
            for dims, (rows, values) in _matrix(table).items():
                at, own = vectors.get(dims, ((), ()))
                if not len(at):
                    continue
                top = max((abs(int(x)) for m in (values, own) for x in (m.min(), m.max()) if m.size), default=0) if dims else 0
                lists = Lists(ids[rows], none[rows], row_marks[rows], row_labels[rows], _exact(values, dims, top))
                own = _exact(own, dims, top)
                for i, anchor in zip(at, own):
                    if asked[i]:
                        alike = lists.labels == labels[i]
                        lists.walk(anchor, (alike & (lists.marks != marks[i])) if same else ~alike, asked[i])

        for batch in batches:
            for low in range(0, len(batch), block):
                held.append(batch.slice(low, block))
                if sum(map(len, held)) >= block:
                    walk()
        if held:
            walk()
        out = [(i, j, None if w.none[r] else int(w.id[r]), int(w.mark[r]), int(w.score[r]))
               for i, own in enumerate(asked) for j, w in enumerate(own) for r in range(len(w.score))]
        columns = list(zip(*out)) or [()] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "window", "id", "mark", "score"])

    return run


_FOUND = "anchor int, window int, id long, mark long, score long"


def hard_negatives(rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block: int = BLOCK,
                   round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every anchor and each of its positives the best
    ``negatives`` rows of another label with ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    A component x counts as floor(scale * x); scores are inner products in whole numbers, higher ones first, ties by smaller id (rows
    without an id last). Positives are the first ``positives`` other rows of the anchor's label. ``anchors`` is a condition
    on the columns of ``rows``. Rows with a null label, a null vector or a null or non-finite component take no part. Vectors
    of different lengths are not compared; empty ones score 0. Rows that repeat an id or a vector are rows of their own: an anchor's copies are
    among its positives. An empty table gives no rows. Scores beyond 64 bits count as the
    nearest 64-bit number. Other columns are ignored. ``round_bytes`` bounds the anchors and windows sent to tasks at once.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    vector = F.col(vector_col)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    fit = rows.where(F.col(label_col).isNotNull() & vector.isNotNull()).where(~odd).select(
        F.monotonically_increasing_id().alias("mark"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"),
        whole.alias("parts"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    fit = scratch.keep(fit.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "rows")
    asking = fit.where("asks")
    n, longest = asking.agg(F.count("*"), F.max(F.size("parts"))).first()
    rounds = max(1, -(-n * (8 * (longest or 0) + 250 * positives * negatives) // round_bytes))
    out = None
    for turn in range(rounds if n else 0):
        own = asking.where(F.pmod(F.xxhash64("mark"), F.lit(rounds)) == turn).select("mark", "id", "label", "parts").toArrow()
        best = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("mark")]
        near = fit.drop("asks").mapInArrow(_searched(own, [[_NO_END]] * len(own), True, positives, block), _FOUND)
        near = scratch.keep(top_per_group(near, ["anchor"], best, positives), f"near{turn}")
        windows = [[] for _ in range(len(own))]
        for row in near.orderBy("anchor", "rank").select("anchor", "score").collect():  # ``positives`` rows per anchor of the round
            windows[row.anchor].append((-(-low * row.score // 100), high * row.score // 100))
        far = fit.drop("asks").mapInArrow(_searched(own, windows, False, negatives, block), _FOUND)
        far = top_per_group(far, ["anchor", "window"], best, negatives)
        names = spark.createDataFrame(own.select(["id"]).append_column("anchor", pa.array(range(len(own)), pa.int32())))
        positive = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = far.join(positive, ["anchor", "window"]).join(names.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        found = scratch.keep(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                          F.col("score").alias("negative_score")), f"found{turn}")
        scratch.drop(f"near{turn}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
