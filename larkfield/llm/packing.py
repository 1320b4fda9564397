"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the plan needs only the number of pieces of each length:
a histogram of at most ``capacity`` rows, whatever the size of the corpus. The plan is a list of bin
patterns with a number of copies. A pattern starts with the longest unpacked length, is filled greedily
with the longest that fits, then its smallest member gives way to two unpacked pieces that fill the
widened gap more tightly. Pieces take places by their number within their length; numbers are given in
two levels (salted groups, then offsets of groups), so no length is numbered by one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch
from larkfield.llm.token_ids import added_tokens, id_encoder

CAPACITY = 2048
SALTS = 256
_ODD_BLANKS = re.compile(r" (?:\s|\Z)")
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder(dict):
    """Text to token ids (little-endian unsigned 32-bit bytes), remembering the ids of frequent chunks.

    A blank before a visible character always starts a token group of this byte-level vocabulary, so
    a text may be cut there; texts with other uses of blanks are encoded whole. The vocabulary's rank
    file and its ``tokenizers`` file give the same ids (tested), but for texts that hold an added token; those are left to ``tokenizers``.
    """

    room = 300_000

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken
        self.name, self.added = name, added_tokens(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.added):  # such tokens are cut out before anything else
            return id_encoder(self.name).of([text])[0]
        if _ODD_BLANKS.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


def piece_encoder(name: str = "byte_bpe_50k") -> PieceEncoder:
    """The worker's encoder of a public vocabulary, loaded once per process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]


def _pieces(capacity: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = memoryview(encoder.ids(text.as_py() or "") + b"\0\0\0\0")
                total = len(ids) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[4 * low:4 * high]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc", "piece", "start", "length", "ids_crc32"])
        encoder.clear()  # workers go on to other stages

    return run


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{length: times}`` with copies that together use every piece once."""
    left = {n: c for n, c in counts.items() if c > 0}
    free = sum(1 << n for n in left)
    back = sum(1 << (capacity - n) for n in left)

    def take(n: int, by: int) -> None:
        nonlocal free, back
        left[n] = left.get(n, 0) - by
        if left[n] > 0:
            free |= 1 << n
            back |= 1 << (capacity - n)
        else:
            free &= ~(1 << n)
            back &= ~(1 << (capacity - n))

    def fill(own: list[int], gap: int) -> int:
        while gap and (n := (free & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            own.append(n)
            take(n, 1)
            gap -= n
        return gap

    def best_two(room: int, more_than: int) -> tuple[int, int] | None:
        for total in range(room, max(more_than, 1), -1):
            sums = free & (back >> (capacity - total))
            while sums:
                n = sums.bit_length() - 1
                if 2 * n != total or left[n] > 1:
                    return n, total - n
                sums &= ~(1 << n)
        return None

    bins = []
    while free:
        first = free.bit_length() - 1
        own = [first]
        take(first, 1)
        gap = fill(own, capacity - first)
        if gap and len(own) > 1:
            smallest = min(own)
            pair = best_two(gap + smallest, smallest)
            if pair:
                own.remove(smallest)
                for n in pair:
                    take(n, 1)
                take(smallest, -1)
                own += pair
                fill(own, capacity - sum(own))
        times = {n: own.count(n) for n in set(own)}
        more = min(left[n] // k for n, k in times.items())
        for n, k in times.items():
            take(n, more * k)
        bins.append((times, more + 1))
    return bins


def _places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset, times in the pattern), sorted."""
    rows, used, sequence = [], {}, 0
    for times, copies in bins:
        offset = 0
        for n in sorted(times, reverse=True):
            rows.append((n, used.get(n, 0), sequence, offset, times[n]))
            used[n] = used.get(n, 0) + copies * times[n]
            offset += n * times[n]
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(places: np.ndarray):
    keys = (places[:, 0] << 48) + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            at = places[np.searchsorted(keys, (length << 48) + number, "right") - 1] if len(length) else np.empty((0, 5), np.int64)
            turn = number - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(at[:, 2] + turn // at[:, 4]),
                 pa.array(at[:, 3] + turn % at[:, 4] * length)],
                ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str = "byte_bpe_50k", salts: int = SALTS) -> DataFrame:
    """``<id>, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Null texts count as empty: one piece that holds the closing id 0 alone. Only documents over the
    capacity are cut; their first piece may be shorter. Repeated rows and ids are packed as they are, null
    ids too. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.keep(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
                          .mapInArrow(_pieces(capacity, vocabulary), shape), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = _places(plan_bins(counts, capacity))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "salt"]).select(
        "doc", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("own") - 1).alias("number"))
    return numbered.mapInArrow(_placed(places), shape + ", sequence_id long, offset long").withColumnRenamed("doc", id_col)
