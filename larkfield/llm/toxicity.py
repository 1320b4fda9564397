"""Toxic passages by maximum-scoring segment search over token log-odds.

Terms are words and their beginnings of three to eight letters. Term scores are log-odds of the toxic against the
clean class with an informative Dirichlet prior taken from the counts of all documents, less one standard
deviation; a token scores as the best of its terms, and one without a sure term costs a little. A
linear-time scan finds all maximal segments of a text. A segment of score S in a text of n words is
expected K n exp(-lambda S) times by chance; segments expected less than ``alpha`` times are toxic passages.
A document's score is the calibrated sum of -log expectations over its passages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch
from larkfield.llm.quality import fit_logistic

WORD = re.compile(r"[^\W\d_]+")
STEP = -0.05
#: A term counts at most so often in one text, so that one text of a repeated word does not decide its score.
MOST = 20
PASSAGE = "array<struct<start: int, end: int, score: double, expected: double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in range(3, min(8, len(word)) + 1))]


class Known(dict):
    """Word to what ``found`` makes of its terms, remembered for frequent words."""

    room = 300_000

    def __init__(self, found):
        self.found = found

    def __missing__(self, word: str):
        if len(self) >= self.room:
            self.clear()
        self[word] = value = self.found(word)
        return value


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)``, disjoint, by one scan with a stack of candidates."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, i + 1, left, right))
                break
            start, _, left, _ = stack[j]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


def compressed_segments(places: np.ndarray, values: np.ndarray, step: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a text whose words all cost ``step`` but for those at ``places``."""
    scores, starts = [], []
    last = -1
    for p, v in zip(places.tolist(), values.tolist()):
        if p - last > 1:
            scores.append(step * (p - last - 1))
            starts.append(last + 1)
        scores.append(v)
        starts.append(p)
        last = p
    return [(starts[a], starts[b - 1] + 1, s) for a, b, s in maximal_segments(scores)]


def _rows_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms in each class, and toxic rows that hold them; the empty term counts rows."""
    sums = (Counter(), Counter(), Counter())

    def told() -> pa.RecordBatch:
        names = list(sums[0].keys() | sums[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[w] for w in names], pa.int64()) for s in sums)],
                                         ["term", "n0", "n1", "rows1"])
        for s in sums:
            s.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(1), batch.column(2).to_pylist()):
            own = Counter()
            for word, n in Counter(words_of(text.as_py())).items():
                for term in terms(word):
                    own[term] += n
            own[""] = 1
            sums[label].update({term: min(n, MOST) for term, n in own.items()})
            if label:
                sums[2].update(own.keys())
            if len(sums[0]) + len(sums[1]) > 200_000:
                yield told()
    yield told()


def _corpus_counts(wanted: frozenset):
    """How often each wanted term occurs; the empty term counts the words of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()
        known = Known(lambda word: tuple(t for t in terms(word) if t in wanted))
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                sums[""] += len(words)
                for own in filter(None, map(known.__getitem__, words)):
                    sums.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    return run


class Model:
    """Term scores and calibration; small enough to be sent with a task (bounded by the fitting sample)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.rate, self.density, self.slope, self.shift, self.alpha = 1.0, 1.0, 1.0, 0.0, 0.5

    def reader(self) -> Known:
        """Score of a word, 0 for those without a sure term."""
        return Known(lambda word: max((self.scores.get(t, 0.0) for t in terms(word)), default=0.0))

    def segments(self, words: list[str], reader: Known) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        values = np.fromiter(map(reader.__getitem__, words), float, len(words))
        places = np.flatnonzero(values > 0)
        return compressed_segments(places, values[places], STEP), values[places]

    def passages(self, n: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
        found = ((a, b, s, self.density * max(n, 1) * math.exp(-self.rate * s)) for a, b, s in segments)
        return [x for x in found if x[3] < self.alpha]

    def statistic(self, passages: list[tuple[int, int, float, float]]) -> float:
        return math.log1p(sum(-math.log(max(e, 1e-300)) for *_, e in passages))

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * statistic + self.shift, -30), 30)))

    def calibrate_chance(self, sizes: list[int], sums: list[float], hits: list[float]) -> None:
        """Rate: the positive root of E[exp(rate * score)] = 1 over words of clean rows. Density: chance segments per word."""
        hits = np.array([*hits, max(self.scores.values(), default=1.0)])
        total = sum(sizes) + len(hits)
        low, high = 1e-6, 50.0 / hits.max()
        for _ in range(80):
            middle = (low + high) / 2
            excess = (1 - len(hits) / total) * math.exp(middle * STEP) + np.exp(middle * hits).sum() / total - 1
            low, high = (middle, high) if excess < 0 else (low, middle)
        self.rate = low
        least = min(sums, default=float(hits.min()))
        self.density = (len(sums) + 0.5) / (total * math.exp(-self.rate * least))


def _sample_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            sizes, sums, hits = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                own, values = model.segments(words, reader)
                sizes.append(len(words))
                sums.append([s for *_, s in own])
                hits.append(values.tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(sums, kind), pa.array(hits, kind)],
                ["label", "part", "n", "sums", "hits"])

    return run


def _scored(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                raw = text.as_py() or ""
                words = words_of(raw)
                own = model.passages(len(words), model.segments(words, reader)[0])
                scores.append(model.probability(model.statistic(own)))
                at = [m.span() for m in WORD.finditer(raw)] if own else []
                same = len(at) == len(words)
                spans.append([{"start": at[a][0] if same else 0, "end": at[b - 1][1] if same else len(raw), "score": s, "expected": e}
                              for a, b, s, e in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc", "score", "passages"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    fit_rows: int = 12_000, least_rows: int = 5, sure: float = 4.5, prior: float = 500.0) -> DataFrame:
    """``<id>, score, passages`` for every row of ``docs``; ``labels`` (id, label 0 or 1) are the rows to learn from.

    Learns from at most ``fit_rows`` labelled rows, those with the smallest id hashes; three quarters give
    token scores, the rest the calibration. Prior counts cover all documents. Null and blank texts have no
    passages and get the score of none. Without labels of both classes every score is the share of label 1
    (0 without any). Repeated rows are scored each; extra columns are ignored. Passages
    are character spans; where lower-casing changes the word count, the span is the whole text.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc", F.lit(9)), "doc").limit(fit_rows)
    chosen = F.broadcast(chosen.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(10)), F.lit(4)) > 0))  # bounded by the limit
    pairs = texts.join(chosen, "doc").select("doc", "text", "label", "part")
    sums = Scratch(docs.sparkSession).keep(
        pairs.where("part").mapInArrow(_rows_with, "term string, n0 long, n1 long, rows1 long").groupBy("term").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("rows1").alias("rows1")), "terms")
    word, row = (F.col("term") != "") & ~F.col("term").endswith("*"), F.col("term") == ""
    totals = sums.agg(*(F.sum(F.when(which, F.col(n))) for which in (word, row) for n in ("n0", "n1"))).first()
    n0, n1, rows0, rows1 = (x or 0 for x in totals)
    if not rows0 or not rows1:
        share = rows1 / (rows0 + rows1) if rows0 + rows1 else 0.0
        return texts.select(F.col("doc").alias(id_col), F.lit(share).cast("double").alias("score"), F.array().cast(PASSAGE).alias("passages"))
    # Candidates occur in several toxic rows and take a larger share of their words than of the clean ones.
    least = min(least_rows, rows1)
    candidates = sums.where((F.col("term") != "") & (F.col("rows1") >= least) & (F.col("n1") * max(n0, 1) > F.col("n0") * n1 * math.e)).collect()
    corpus = texts.select("text").mapInArrow(_corpus_counts(frozenset(r.term for r in candidates)), "term string, n long")
    corpus = {r.term: r.n for r in corpus.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    scores = {}
    for r in candidates:
        own = prior * corpus.get(r.term, 0) / max(corpus.get("", 0), 1) + 0.5
        odds = math.log((r.n1 + own) / max(n1 + prior - r.n1 - own, 1)) - math.log((r.n0 + own) / max(n0 + prior - r.n0 - own, 1))
        spread = math.sqrt(1 / (r.n1 + own) + 1 / (r.n0 + own))
        if odds >= (sure if rows1 >= 50 else 2) * spread:
            scores[r.term] = max(odds - spread, 0.1)
    model = Model(scores)
    sample = pairs.mapInArrow(_sample_rows(model), "label int, part boolean, n long, sums array<double>, hits array<double>").toPandas()
    clean = sample[sample["label"] == 0]
    model.calibrate_chance(list(clean["n"]), [x for s in clean["sums"] for x in s], [x for h in clean["hits"] for x in h])
    y, part = sample["label"].to_numpy(float), sample["part"].to_numpy(bool)
    x = np.array([model.statistic(model.passages(n, [(0, 0, s) for s in own])) for n, own in zip(sample["n"], sample["sums"])])
    held = ~part if len(set(y[~part])) == 2 else np.ones(len(y), bool)
    model.slope, model.shift = fit_logistic(x[held], y[held])
    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(_scored(model), f"doc {kind}, score double, passages {PASSAGE}").withColumnRenamed("doc", id_col)
