"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document is the set of its distinct word shingles. Equal sets are one node. Signatures are cut into
bands; nodes that share a band are candidates. A candidate pair is compared batch by batch: after each
batch of signature positions, the posterior of the similarity (uniform prior) says how likely it still
reaches the threshold, and the pair is dropped once that is below ``miss``. Survivors are confirmed on
their full sets.

Large bands are not turned into all pairs. Each node is first compared with its band's smallest node. Bands
that still hold more than one component afterwards are looked at again, only across components: small ones
as pairs of rows, large ones inside tasks, where the nodes outside the band's main component meet blocks of
all its nodes and only links that join components come out. So no link between components is lost, and no
group of near copies becomes rows for all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch, WordHashes, ascii_words, components, gram_hashes, mixed

BAND_ROWS = 5
BANDS = 40
BATCH = 20
#: Bands of more nodes than this are compared inside tasks, in blocks of at most about BLOCK nodes.
PAIRS_UP_TO = 16
BLOCK = 512


def shingle_hashes(text: str | bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, an empty one has none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words), min(n, len(words))))


def _permutations(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    return (draw() | np.uint32(1))[:, None], draw()[:, None]


def signature(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the set, in blocks that stay in the cache."""
    low = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):
        np.minimum(out, (low[start:start + 1024] * factors + shifts).min(axis=1), out=out)
    return out


def least_matches(total: int, batch: int, threshold: float, miss: float) -> list[int]:
    """Per batch end, the fewest equal positions at which the similarity may still reach the threshold.

    With a uniform prior the posterior after ``m`` of ``n`` matches is Beta(m+1, n-m+1), whose upper
    tail at ``t`` equals P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _features(n: int, seed: int):
    factors, shifts = _permutations(BANDS * BAND_ROWS, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, sizes, signs = [], [], []
            for text in batch.column(1):
                grams = shingle_hashes(text.as_py(), n, hashes)
                sizes.append(len(grams))
                nodes.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None)
                signs.append(signature(grams, factors, shifts).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())],
                ["doc", "size", "node", "sign"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node and band: a hash of the band's number and positions."""
    marks = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, BANDS, BAND_ROWS)
        keys = np.broadcast_to(marks, signs.shape[:2]).copy()
        for i in range(BAND_ROWS):
            keys = mixed(keys * np.uint64(31) + signs[:, :, i].astype(np.uint64))
        repeat = lambda i: np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(repeat(0)), pa.array(repeat(1))], ["key", "node", "size"])


def _plausible(threshold: float, miss: float):
    """Keep pairs whose sizes and signatures leave the threshold likely enough."""
    total = BANDS * BAND_ROWS
    least = np.array(least_matches(total, BATCH, threshold, miss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, total) for i in (2, 3))
            alive = np.arange(len(a))
            matched = np.zeros(len(a), np.int64)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matched[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                alive = alive[matched[alive] >= need]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _confirmed(n: int, percent: int):
    """Keep pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, last_set = None, None
        for batch in batches:
            keep = []
            for row, (a, one, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != last:
                    last, last_set = a, shingle_hashes(one.as_py(), n, hashes)
                theirs = shingle_hashes(other.as_py(), n, hashes)
                both = len(np.intersect1d(last_set, theirs, assume_unique=True))
                if 100 * both >= percent * (len(last_set) + len(theirs) - both):
                    keep.append(row)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _blocks(n: int, percent: int, miss: float, seed: int):
    """Links that join components between the nodes of side x and those of side y of one block."""
    factors, shifts = _permutations(BANDS * BAND_ROWS, seed)
    least = least_matches(BANDS * BAND_ROWS, BATCH, percent / 100, miss)

    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        nodes, roots, first = (table.column(c).to_pylist() for c in ("node", "root", "first"))
        order: dict[int, int] = {}
        sets = []
        for row, node in enumerate(nodes):
            if node not in order:
                order[node] = len(sets)
                sets.append(shingle_hashes(table.column("text")[row].as_py(), n, hashes))
        signs = np.array([signature(s, factors, shifts) for s in sets])
        sizes = np.array([len(s) for s in sets])
        root = np.zeros(len(sets), np.int64)
        for node, r in zip(nodes, roots):
            root[order[node]] = r
        y = np.array(sorted({order[node] for node, f in zip(nodes, first) if not f}), np.int64)
        found = []
        for i in sorted({order[node] for node, f in zip(nodes, first) if f}):
            alive = y[(root[y] != root[i]) & (100 * np.minimum(sizes[y], sizes[i]) >= percent * np.maximum(sizes[y], sizes[i]))]
            matched = np.zeros(len(alive), np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matched += (signs[alive, part] == signs[i, part]).sum(axis=1)
                alive, matched = alive[matched >= need], matched[matched >= need]
            for j in alive[np.argsort(-matched, kind="stable")].tolist():
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        names = {at: node for node, at in order.items()}
        return pa.table({"a": pa.array([names[i] for i, _ in found], pa.int64()), "b": pa.array([names[j] for _, j in found], pa.int64())})

    return run


def _block_links(units: DataFrame, texts: DataFrame, n: int, percent: int, miss: float, seed: int) -> DataFrame:
    """Links across components inside each unit (``unit, node, root``): outsiders against all nodes, in blocks."""
    outside = F.col("root") != F.col("unit")
    sizes = units.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("columns"),
                                      F.ceil(F.count_if(outside) / BLOCK).cast("int").alias("lines"))
    rows = units.join(sizes, "unit").join(texts, "node")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    x = rows.where(outside).select("unit", "node", "root", "text", F.lit(True).alias("first"), own("lines").alias("line"), every("columns").alias("column"))
    y = rows.select("unit", "node", "root", "text", F.lit(False).alias("first"), own("columns").alias("column"), every("lines").alias("line"))
    return x.unionByName(y).groupBy("unit", "line", "column").applyInArrow(_blocks(n, percent, miss, seed), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2,
                    percent: int = 80, miss: float = 1e-6, seed: int = 7) -> DataFrame:
    """Component of near-duplicates per document: ``<id>, n_shingles, component_id, kept``.

    One row per input row. Null and blank texts have no shingles and link with nothing. A null id keeps
    a null component. Rows that repeat an id stay apart: each stands for its own text. Equal texts share
    a component. Other columns are ignored whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    threshold = percent / 100
    rows = scratch.keep(
        texts.mapInArrow(_features(shingle, seed), f"doc {texts.schema['doc'].dataType.simpleString()}, size long, node long, sign binary"), "signatures")
    firsts = rows.where("node is not null and doc is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    firsts = scratch.keep(firsts, "nodes")
    signs = rows.join(firsts, ["node", "doc"]).select("node", "size", "sign")
    bands = scratch.keep(signs.mapInArrow(_bands, "key long, node long, size long").distinct(), "bands")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """One text per node."""
        wanted = nodes.select("node").distinct().join(firsts, "node")
        own = texts.join(wanted, "doc").select("node", "text").mapInArrow(_only_own(shingle), "node long, text string")
        return scratch.keep(own, f"{name}_texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = signs.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sign").alias("sign_a"))
        right = signs.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sign").alias("sign_b"))
        near = (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
        likely = scratch.keep(
            pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "sign_a", "sign_b")
            .mapInArrow(_plausible(threshold, miss), "a long, b long").distinct(), f"{name}_likely")
        full = texts_of(likely.select(F.col("a").alias("node")).union(likely.select("b")), name)
        one = full.select(F.col("node").alias("a"), F.col("text").alias("one"))
        other = full.select(F.col("node").alias("b"), F.col("text").alias("other"))
        links = scratch.keep(
            likely.join(other, "b").join(one, "a").select("a", "b", "one", "other")
            .mapInArrow(_confirmed(shingle, percent), "a long, b long").distinct(), f"{name}_links")
        scratch.drop(f"{name}_texts", f"{name}_likely")
        return links

    heads = bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a != last").select("key", "a")
    stars = scratch.keep(bands.join(heads, "key").where("node != a").select("a", F.col("node").alias("b")).distinct(), "stars")
    links = verified(stars, "star")
    roots = scratch.keep(components(links, scratch, "first"), "first_roots")
    placed = bands.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    rest = scratch.keep(placed.join(mixed_keys, "key"), "rest")
    counts = rest.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.max_by("root", "count").alias("unit"))
    few = rest.join(counts.where(F.col("n") <= PAIRS_UP_TO).select("key"), "key")
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
                    & (F.col("x.size") * 100 >= F.col("y.size") * percent) & (F.col("y.size") * 100 >= F.col("x.size") * percent))
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(scratch.keep(across, "across"), "across")
    many = scratch.keep(rest.join(counts.where(F.col("n") > PAIRS_UP_TO).select("key", "unit"), "key").select("unit", "node", "root").distinct(), "units")
    in_blocks = _block_links(many, texts_of(many, "unit"), shingle, percent, miss, seed)
    roots = components(links.union(more).union(in_blocks), scratch, "second")
    named = firsts.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component"))
    of_node = named.join(smallest, "root").select("node", "component")
    scratch.drop("bands", "rest", "stars", "across", "units", "unit_texts")
    component = F.coalesce("component", F.col("doc"))
    return rows.select("doc", "size", "node").join(of_node, "node", "left").select(
        F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"),
        (F.col("doc") == component).alias("kept"))


def _only_own(n: int):
    """Of rows that repeat an id, keep those whose text makes the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [node == xxhash.xxh3_64_intdigest(shingle_hashes(text.as_py(), n, hashes).tobytes()) - (1 << 63)
                   for node, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield batch.filter(pa.array(own, pa.bool_()))

    return run
