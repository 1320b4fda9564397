"""Quality classifier: linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are word 1- and 2-grams and 1- to 3-grams of token shapes (letter case, digits, signs, whether
a token repeats the one before), the latter at several levels of their share in the text. Class counts of
all indicators are summed over every labelled row. The linear model is fitted by dual coordinate descent
on a bounded sample of labelled rows (``fit_rows``), and its margin is turned into a probability on
another bounded sample (``calibration_rows``). Both samples are the labelled rows with the smallest id hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import gram_hashes, mixed

SLOTS = 1 << 18
LEVELS = (0.0, 1 / 64, 1 / 16, 1 / 4)
#: Up to so many labels go to every task by broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast when its row count is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Tokens(dict):
    """Token to a row of the tables of word and shape hashes; starts anew when full."""

    room = 300_000

    def __init__(self):
        self.shapes, self.words = np.empty(self.room, np.uint64), np.empty(self.room, np.uint64)

    def __missing__(self, token: str) -> int:
        self[token] = place = len(self)
        if place >= len(self.words):
            self.shapes, self.words = (np.concatenate([x, np.empty_like(x)]) for x in (self.shapes, self.words))
        self.words[place] = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass"))
        self.shapes[place] = xxhash.xxh3_64_intdigest(shape(token))
        return place

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > self.room:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return at, self.shapes[at], self.words[at]


def shape(token: str) -> str:
    """Case of the letters, digits, and each sign once (twice when it repeats)."""
    if token.isalpha() and len(token) <= 24:
        return "x" if token.islower() else "Xx" if token[1:].islower() else "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "xX"
    letters = "".join(c for c in token if c.isalpha())
    case = "" if not letters else "X" if len(letters) > 1 and letters.isupper() else "x" if letters.islower() else "Xx" if letters[0].isupper() else "xX"
    signs: dict[str, int] = {}
    for c in token:
        if not c.isalnum():
            signs[c] = signs.get(c, 0) + 1
    return case + "9" * any(c.isdigit() for c in token) + "".join(c * min(n, 2) for c, n in signs.items()) + "l" * (len(letters) > 24)


def indicators(text: str | None, tokens: Tokens) -> np.ndarray:
    """Sorted distinct slots of a text; none for null and blank texts."""
    parts = (text or "").split()
    if not parts:
        return np.empty(0, np.int64)
    at, shapes, words = tokens.of(parts)
    again = np.zeros(len(at), np.uint64)
    again[1:] = at[1:] == at[:-1]
    shapes = mixed(shapes + again)
    found = [np.unique(words), np.unique(gram_hashes(words, 2)) + np.uint64(1)]
    for n in (1, 2, 3):
        grams, times = np.unique(gram_hashes(shapes, n), return_counts=True)
        for level, least in enumerate(LEVELS):
            found.append(mixed(grams[times >= least * len(parts)] + np.uint64(10 * n + level + 100)))
    return np.unique(mixed(np.concatenate(found)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many rows of each class a slot occurs; slot -1 counts the rows."""
    tokens = Tokens()
    sums = np.zeros((2, SLOTS + 1), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(1), batch.column(2).to_pylist()):
            own = indicators(text.as_py(), tokens)
            sums[label, own] += 1
            sums[label, SLOTS] += 1
    some = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.where(some == SLOTS, -1, some)), pa.array(sums[0, some]), pa.array(sums[1, some])], ["slot", "n0", "n1"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        slots = [indicators(text.as_py(), tokens).astype(np.int32).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(slots, pa.binary())], ["label", "part", "slots"])


def _used(slots: pa.ChunkedArray, scale: np.ndarray) -> list[np.ndarray]:
    """Per row the slots with a scale, as views of one array."""
    parts = [np.frombuffer(s.as_buffer() or b"", np.int32) for s in (slots.chunk(0) if slots.num_chunks else ())]
    flat = np.concatenate(parts or [np.empty(0, np.int32)])
    keep = scale[flat] != 0
    ends = np.concatenate([[0], np.cumsum(keep)])[np.cumsum([0, *map(len, parts)])]
    flat = flat[keep]
    return [flat[low:high] for low, high in zip(ends, ends[1:])]


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights of a linear model with squared hinge loss, by dual coordinate descent.

    Row ``i`` holds ``scale`` at its slots, over its length; ``cost`` is the loss weight of a row.
    """
    signs = np.where(labels == 1, 1.0, -1.0)
    weights, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    lengths = [max(np.sqrt((scale[r] ** 2).sum()), 1e-12) for r in rows]
    own = [((scale[r] / n) ** 2).sum() for r, n in zip(rows, lengths)]
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            if not own[i]:
                continue
            slack, values = 0.5 / cost[i], scale[rows[i]] / lengths[i]
            step = signs[i] * (weights[rows[i]] @ values) - 1 + slack * alpha[i]
            new = max(alpha[i] - step / (own[i] + slack), 0.0)
            if new != alpha[i]:
                weights[rows[i]] += (new - alpha[i]) * signs[i] * values
                alpha[i] = new
    return weights


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(-(slope x + shift))), by damped Newton steps."""
    theta = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * theta
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return float(theta[0]), float(theta[1])


def _scored(weights: np.ndarray, squares: np.ndarray, slope: float, shift: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            margins = []
            for text in batch.column(1):
                own = indicators(text.as_py(), tokens)
                length = np.sqrt(squares[own].sum())
                margins.append(weights[own].sum() / length if length else 0.0)
            scores = 1 / (1 + np.exp(-np.clip(slope * np.array(margins) + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", fit_rows: int = 6000, calibration_rows: int = 2000,
                   least_rows: int = 10) -> DataFrame:
    """``<id>, score`` for every row of ``docs``; ``labels`` (id, label 0 or 1) are the rows to learn from.

    Null, blank and unknown-only texts get the score of a zero margin. Labels that are null or neither 0 nor
    1 are not used; without labels of both classes every score is the share of label 1 (0.5 without
    any). Repeated rows are scored each; extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label"))
    pairs = texts.join(sized(known), "doc").select("doc", "text", "label")
    sums = pairs.mapInArrow(_class_counts, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0"), F.sum("n1")).toArrow()  # at most SLOTS + 1 rows
    counts = np.zeros((2, SLOTS + 1))
    counts[:, sums.column(0).to_numpy()] = [sums.column(i).to_numpy() for i in (1, 2)]
    total, counts = counts[:, -1], counts[:, :-1]
    if not total.all():
        prior = float(total[1] / total.sum()) if total.sum() else 0.5
        return texts.select(F.col("doc").alias(id_col), F.lit(prior).alias("score"))
    ratio = np.log((counts[1] + 1) / (total[1] + 2)) - np.log((counts[0] + 1) / (total[0] + 2))
    scale = np.where(counts.sum(axis=0) >= min(least_rows, total.min()), ratio, 0.0)
    chosen = known.orderBy(F.xxhash64("doc", F.lit(6)), "doc").limit(fit_rows + calibration_rows)
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(fit_rows + calibration_rows)) < fit_rows)
    sample = texts.join(F.broadcast(chosen), "doc").select("doc", "text", "label", "part")  # bounded by the limit above
    sample = sample.mapInArrow(_rows, "label int, part boolean, slots binary").toArrow().combine_chunks()
    rows = _used(sample.column("slots"), scale)
    y, fit = sample.column("label").to_numpy(), sample.column("part").to_numpy()
    del sample
    inside = np.flatnonzero(fit)
    share = y[inside].mean() if len(inside) else 0.5
    cost = np.where(y[inside] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    weights = fit_hinge([rows[i] for i in inside], y[inside], scale, cost) * scale
    squares = scale ** 2
    margin = np.array([weights[r].sum() / max(np.sqrt(squares[r].sum()), 1e-12) for r in rows])
    other = ~fit if len(set(y[~fit])) == 2 else np.ones(len(y), bool)
    slope, shift = fit_logistic(margin[other], y[other])
    return texts.mapInArrow(_scored(weights, squares, slope, shift), f"doc {texts.schema['doc'].dataType.simpleString()}, score double").withColumnRenamed("doc", id_col)
