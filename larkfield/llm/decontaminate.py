"""Benchmark passages in documents by latent semantic retrieval, confirmed by longest common subsequences.

Benchmark texts become passages; their TF-IDF matrix (idf from all documents) is factored by a randomised SVD whose
products with the matrix are summed over the passage rows in Spark. Windows of every document are folded into
the factor space and compared with all passages by cosine, over the window's full TF-IDF length; windows
whose words of the benchmark vocabulary can't reach the least cosine are passed over (Cauchy-Schwarz). A
candidate counts when a large share of the passage's words comes, in order, near the window; passages with
an answer need the answer too, or a higher share.

Benchmarks are taken in blocks of no more passages than the rank, so the factors of a block span its passages
and a verbatim copy keeps its whole length. About ``BLOCK`` passages, in several blocks with their own factors,
are searched in one pass over the documents, so what is sent with a task is bounded; every block meets all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch, mixed

BLOCK = 1024
BUCKETS = 1 << 17
RANK = 256
STEP = 8
SCALES = (24, 32, 48, 64, 96)
PASSAGE, PASSAGE_STEP = 64, 32
CHUNK, TOGETHER = 4 << 20, 1 << 16
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


class Words:
    """The words of a text: runs of ASCII letters, digits and non-ASCII characters, in lower case, with their hashes."""

    def __init__(self, text: str | None):
        self._set((text or "").lower().encode("utf-8"))

    def _set(self, data: bytes) -> None:
        self.data = data
        parts = [self._read(low, high) for low, high in self._chunks()]
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]

    @classmethod
    def of_many(cls, texts: Iterator[str | None]) -> Iterator[Words]:
        """One object per text; short texts are read together, which saves most of the calls."""
        group, size = [], 0
        for text in texts:
            group.append((text or "").lower().encode("utf-8"))
            size += len(group[-1])
            if size >= TOGETHER:
                yield from cls._split(group)
                group, size = [], 0
        yield from cls._split(group)

    @classmethod
    def _split(cls, group: list[bytes]) -> Iterator[Words]:
        if not group:
            return
        whole = cls.__new__(cls)
        whole._set(b"\n".join(group))
        ends = np.cumsum([len(g) + 1 for g in group])
        cuts = [0, *np.searchsorted(whole.starts, ends).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            own = cls.__new__(cls)
            own.data = whole.data
            own.starts, own.ends, own.hashes = (x[low:high] for x in (whole.starts, whole.ends, whole.hashes))
            yield own

    def __len__(self) -> int:
        return len(self.hashes)

    def at(self, low: int, high: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[low:high].tolist(), self.ends[low:high].tolist())]

    def _chunks(self) -> list[tuple[int, int]]:
        """Cuts of long texts, none inside a word."""
        cuts, at = [0], CHUNK
        while at < len(self.data):
            while at < len(self.data) and _IS_WORD[self.data[at]]:
                at += 1
            cuts.append(at)
            at += CHUNK
        return list(zip(cuts, [*cuts[1:], len(self.data)]))

    def _read(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        global _powers
        raw = np.frombuffer(self.data, np.uint8, high - low, low)
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = _IS_WORD[raw]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return starts, ends, np.empty(0, np.uint64)
        lengths = ends - starts
        while len(_powers) < lengths.max():
            more = _powers * np.uint64(pow(_BASE, len(_powers), 1 << 64))
            _powers = np.concatenate([_powers, more])
        firsts = np.cumsum(lengths) - lengths
        letters = raw[word[1:-1]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(firsts, lengths)
        return starts + low, ends + low, mixed(np.add.reduceat(letters * _powers[place], firsts))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


class Vocabulary:
    """Terms by hash; a table of buckets passes over most words that are none."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.some = np.zeros(BUCKETS, bool)
        self.some[bucket_of(self.hashes)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word, -1 for words outside."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.some[bucket_of(hashes)])
        at = np.searchsorted(self.hashes, hashes[maybe]).clip(max=len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents each bucket occurs; bucket -1 counts the documents."""
    sums, total = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for words in Words.of_many(t.as_py() for t in batch.column(0)):
            sums[np.unique(bucket_of(words.hashes))] += 1
        total += batch.num_rows
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], total))], ["bucket", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of at most PASSAGE words, with their words joined by blanks."""
    for batch in batches:
        row, part, texts = [], [], []
        for i, text in enumerate(batch.column(1)):
            words = Words(text.as_py())
            for k, at in enumerate(range(0, max(len(words) - PASSAGE_STEP, 1), PASSAGE_STEP) if len(words) > PASSAGE else range(min(len(words), 1))):
                row.append(i)
                part.append(k)
                texts.append(b" ".join(words.at(at, at + PASSAGE)).decode("utf-8"))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), pa.array(part, pa.int32()), pa.array(texts, pa.string()), batch.column(2).take(take)],
            ["item", "part", "words", "answer"])


def passage_vector(words: str, terms: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit TF-IDF weights of a passage."""
    at, times = np.unique(terms.of(Words(words).hashes), return_counts=True)
    weights = times * idf[at]
    return at, weights / max(np.sqrt((weights ** 2).sum()), 1e-12)


def _product(terms: Vocabulary, idf: np.ndarray, basis: np.ndarray):
    """Per task: the sum of a' (a basis) over the passage rows a, as blocks of term rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(basis.shape)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                at, weights = passage_vector(words, terms, idf)
                out[at] += np.outer(weights, weights @ basis[at])
        blocks = range(0, len(out), 256)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // 256 for b in blocks], pa.int32()), pa.array([out[b:b + 256].tobytes() for b in blocks], pa.binary())], ["block", "rows"])

    return run


def _block_sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("rows"))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "rows": pa.array([total.tobytes()], pa.binary())})


def randomised_factors(passages: DataFrame, terms: Vocabulary, idf: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the passages' TF-IDF matrix A.

    A random start is multiplied by A'A (with one power step) and made orthonormal; the small matrix of A'A on that
    base gives the vectors. Products are summed over Spark tasks; the driver holds terms x rank numbers.
    """
    width = min(rank + 10, len(terms))

    def times_gram(basis: np.ndarray) -> np.ndarray:
        sums = passages.select("words").mapInArrow(_product(terms, idf, basis), "block int, rows binary")
        rows = sums.groupBy("block").applyInArrow(_block_sum, "block int, rows binary").orderBy("block").collect()
        return np.concatenate([np.frombuffer(r.rows, np.float64).reshape(-1, basis.shape[1]) for r in rows])

    basis = np.random.default_rng(seed).standard_normal((len(terms), width))
    for _ in range(2):
        basis, _ = np.linalg.qr(times_gram(basis))
    values, turn = np.linalg.eigh(basis.T @ times_gram(basis))
    return (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one pass of bit operations."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for word in b:
        hit = state & places.get(word, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _holds(words: list, wanted: list) -> bool:
    n = len(wanted)
    return any(words[i:i + n] == wanted for i in range(len(words) - n + 1))


def _leaks(index: dict, least_cosine: float, share: float, share_without_answer: float):
    """Leaks of one block of passages in a document: a function of the document's row number and words."""
    terms, bucket_idf, factors, vectors = (index[k] for k in ("terms", "bucket_idf", "factors", "vectors"))
    items, parts, texts, answers = (index[k] for k in ("items", "parts", "texts", "answers"))
    sizes = np.array([len(t) for t in texts])
    most = index["most"]
    members = np.zeros((len(texts), len(terms)), bool)
    for i, words in enumerate(texts):
        members[i, terms.of(Words(b" ".join(words).decode("utf-8")).hashes)] = True

    def candidates(words: Words, own: np.ndarray) -> list[tuple[float, int, int, int]]:
        """Windows and passages with at least the least cosine: ``(-cosine, first word, end, passage)``."""
        known = own >= 0
        weight = bucket_idf[bucket_of(words.hashes)].astype(np.float64)
        squares = weight ** 2
        n = len(words)
        top = np.where(known, weight * most[own], 0)
        inside, whole, reach = (np.append(0, np.cumsum(x)) for x in (np.where(known, squares, 0), squares, top))
        lows, highs = [], []
        for scale in SCALES:
            step = STEP if scale < 64 else 2 * STEP
            low = np.arange(0, max(n - scale, 0) + step, step) if n > scale else np.zeros(1, np.int64)
            high = np.minimum(low + scale, n)
            # No cosine is above either bound: the share of the window's length in the vocabulary, or the sum with the
            # largest weight each word has in any passage. A word that comes again counts again in
            # the sums; the true length of the window is no smaller.
            square = whole[high] - whole[low]
            good = (inside[high] - inside[low] >= least_cosine ** 2 * square) & (reach[high] - reach[low] >= least_cosine * np.sqrt(square))
            lows.append(low[good])
            highs.append(high[good])
            if n <= scale:
                break
        low, high = np.concatenate(lows), np.concatenate(highs)
        if not len(low):
            return []
        # Factor sums of steps of words, then of windows; only steps in some window are looked up.
        steps = -(-n // STEP)
        used = np.zeros(steps + 1, np.int64)
        np.add.at(used, low // STEP, 1)
        np.add.at(used, -(-high // STEP), -1)
        used = np.cumsum(used)[:steps] > 0
        at = np.flatnonzero(known & used[np.arange(n) // STEP])
        sums = np.zeros((steps + 1, factors.shape[1]), np.float32)
        if len(at):
            firsts = np.flatnonzero(np.append(True, np.diff(at // STEP) > 0))
            sums[at[firsts] // STEP + 1] = np.add.reduceat(factors[own[at]] * weight[at, None].astype(np.float32), firsts, axis=0)
        sums = np.cumsum(sums, axis=0)
        found = []
        for part in range(0, len(low), 4096):
            a, b = low[part:part + 4096], high[part:part + 4096]
            cosines = (sums[-(-b // STEP)] - sums[a // STEP]) @ vectors.T / np.sqrt(whole[b] - whole[a])[:, None]
            # Words that come again make a window longer than the sums say.
            for i in np.flatnonzero((cosines >= least_cosine).any(axis=1)).tolist():
                _, first, times = np.unique(words.hashes[a[i]:b[i]], return_index=True, return_counts=True)
                if len(times) < b[i] - a[i]:
                    again = squares[a[i] + first]
                    cosines[i] *= math.sqrt((again * times).sum() / (again * times ** 2).sum())
            row, k = np.nonzero(cosines >= least_cosine)
            found += zip((-cosines[row, k]).tolist(), a[row].tolist(), b[row].tolist(), k.tolist())
        return sorted(found)

    def leaks(row: int, words: Words) -> list[tuple]:
        best: dict[int, tuple] = {}
        own = terms.of(words.hashes)
        for minus, low, high, k in candidates(words, own):
            if k in best:
                continue
            margin = int(sizes[k]) // 2
            low, high = max(0, low - margin), min(len(words), high + margin)
            near = own[low:high]
            # No common subsequence is longer than the words of the window that the passage has at all.
            if members[k, near[near >= 0]].sum() < share * sizes[k]:
                continue
            near = words.at(low, high)
            part = common_subsequence(texts[k], near) / sizes[k]
            answered = answers[k] is None or _holds(near, answers[k])
            if part >= (share if answered else share_without_answer):
                best[k] = (row, items[k], parts[k], -minus, part, answered and answers[k] is not None, low, high)
        return list(best.values())

    return leaks


def _search(indexes: list[dict], least_cosine: float, share: float, share_without_answer: float):
    """Per task: the leaks of all given blocks; documents are read once."""
    blocks = [_leaks(index, least_cosine, share, share_without_answer) for index in indexes]
    item_type = indexes[0]["item_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, words in enumerate(Words.of_many(t.as_py() for t in batch.column(1))):
                if len(words):
                    for leaks in blocks:
                        rows += leaks(row, words)
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_type),
                 *(pa.array([r[i + 2] for r in rows], t) for i, t in enumerate(kinds))],
                ["doc", "item", "part", "cosine", "share", "answered", "first_word", "end_word"])

    return run


def _in_blocks(passages: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``passages`` with ``block``, no block of more than ``size`` rows, and the number of blocks.

    Rows are numbered from the counts of the tasks that write them, so equal rows may be in different blocks.
    """
    rows = scratch.keep(passages.withColumn("number", F.monotonically_increasing_id()), "benchmark")
    task = F.shiftright("number", 33)
    offsets, total = [], 0
    for own, n in rows.groupBy(task.cast("int").alias("task")).count().orderBy("task").collect():  # one row per task
        offsets.append((own, total))
        total += n
    offsets = passages.sparkSession.createDataFrame(offsets, "task int, before long")
    place = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn("task", task.cast("int")).join(offsets, "task").withColumn("block", F.floor(place / size).cast("int"))
    return scratch.keep(placed.drop("task", "before", "number"), "blocks"), math.ceil(total / size)


def leaked_passages(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", answer_col: str | None = None, least_cosine: float = 0.5, share: float = 0.6,
                    share_without_answer: float = 0.8, rank: int = RANK) -> DataFrame:
    """``<doc id>, <item id>, part, cosine, share, answered, first_word, end_word`` per document row and leaked passage.

    Texts are read as runs of letters, digits and non-ASCII characters in lower case. Null and wordless documents and items match nothing; an
    empty benchmark or corpus gives no rows. Repeated rows are searched each; a benchmark item that
    repeats is found once per repeat. ``rank`` is the most passages of a block too. Other columns are ignored, also those of the same name in both tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    raw = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"), answer.alias("answer"))
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((texts, "doc"), (raw, "item")))
    passages, blocks = _in_blocks(raw.mapInArrow(_cut, f"item {item_kind}, part int, words string, answer string"), rank, scratch)
    shape = f"doc {doc_kind}, item {item_kind}, part int, cosine double, share double, answered boolean, first_word int, end_word int"
    empty = spark.createDataFrame([], shape)
    document_counts, total = np.zeros(BUCKETS), 0
    if blocks:  # at most BUCKETS + 1 rows
        counts = texts.select("text").mapInArrow(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        bucket, n = (counts.column(c).to_numpy() for c in ("bucket", "n"))
        document_counts[bucket[bucket >= 0]] = n[bucket >= 0]
        total = int(n[bucket < 0].sum())
    bucket_idf = np.log((total + 1) / (document_counts + 0.5)).clip(0.05).astype(np.float32)
    out, indexes = empty, []
    for block in range(blocks):
        own = passages.where(F.col("block") == block)
        rows = own.orderBy("item", "part", "words").toArrow()  # at most ``rank`` passages
        lists = rows.column("words").to_pylist()
        terms = Vocabulary(np.concatenate([Words(w).hashes for w in lists]))
        idf = bucket_idf[bucket_of(terms.hashes)].astype(np.float64)
        factors = randomised_factors(own, terms, idf, len(lists))
        vectors, most = np.zeros((len(lists), factors.shape[1]), np.float32), np.zeros(len(terms))
        for i, words in enumerate(lists):
            at, weights = passage_vector(words, terms, idf)
            vectors[i] = weights @ factors[at]
            most[at] = np.maximum(most[at], weights)
        answers = [(w.at(0, len(w)) or None) for w in map(Words, rows.column("answer").to_pylist())]
        indexes.append({"terms": terms, "bucket_idf": bucket_idf, "factors": factors, "vectors": vectors, "most": most,
                        "items": rows.column("item").to_pylist(), "item_type": rows.schema.field("item").type, "parts": rows.column("part").to_pylist(),
                        "texts": [w.encode("utf-8").split(b" ") for w in lists], "answers": answers})
        if block == blocks - 1 or len(indexes) >= BLOCK // rank:
            out = out.unionByName(texts.mapInArrow(_search(indexes, least_cosine, share, share_without_answer), shape))
            indexes = []
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})
