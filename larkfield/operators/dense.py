"""Dense scoring in blocks: shuffled matrix products without row pairs.

Vectors are hashed into blocks of bounded size and every query block meets
every vector block once. A task multiplies two small matrices and keeps only
the rows asked for, so the number of emitted rows is queries x blocks x k.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import top_per_group
from larkfield.session import durable

VECTORS_PER_BLOCK = 20000
QUERIES_PER_BLOCK = 2000
#: Queries of a block scored at once; bounds a task to this many rows of scores whatever the size of the blocks.
QUERIES_AT_ONCE = 256
#: Queries per block where few rows per query leave a task: the fewer blocks, the fewer copies of the vectors are shuffled.
ASKING_PER_BLOCK = 20000
#: Columns whose k-th best score is the floor for the others.
HEAD = 1024
#: Queries and items scored at once where all pairs that reach a floor leave a task; bounds what a task holds of them, and fits a core's cache.
TILE = (128, 2048)
_SLACK = 2e-9


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, math.ceil(df.count() / size))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _equal_members(left: pd.Series, right: pd.Series) -> Callable[[slice], np.ndarray]:
    """``rows -> mask``: which sets of ``left`` share a member with which sets of ``right``."""
    sets = [[() if x is None else x for x in side] for side in (left, right)]
    names = {x: i for i, x in enumerate({x for side in sets for own in side for x in own})}

    def padded(side, empty):
        out = np.full((len(side), max([1, *map(len, side)])), empty)
        for row, own in enumerate(side):
            out[row, :len(own)] = [names[x] for x in own]
        return out

    a, b = padded(sets[0], -1), padded(sets[1], -2)

    def mask(rows: slice) -> np.ndarray:
        out = np.zeros((len(a[rows]), len(b)), bool)
        for i in range(a.shape[1]):
            for j in range(b.shape[1]):
                out |= a[rows, i, None] == b[None, :, j]
        return out

    return mask


def _scored_blocks(vectors: DataFrame, queries: DataFrame, keep, schema: str, listed: DataFrame | None = None,
                   asking: int | None = None) -> DataFrame:
    """Run ``keep(query_ids, item_ids, scores)`` on every pair of blocks; ``listed`` pairs score minus infinity.

    A query's listed items travel with it, each only to the block that holds
    the item, so a task has no more of them than scores. Where both tables have ``labels`` (sets),
    pairs that share one score minus infinity too. ``keep`` sees ``QUERIES_AT_ONCE`` queries at a time.
    """
    parts = vectors.sparkSession.sparkContext.defaultParallelism
    n_v = max(_blocks(vectors, VECTORS_PER_BLOCK), min(parts, _blocks(vectors, 100)))
    n_q = _blocks(queries, asking or QUERIES_PER_BLOCK)
    labelled = "labels" in vectors.columns and "labels" in queries.columns
    left = vectors.select(F.pmod(F.xxhash64("item_id"), F.lit(n_v)).cast("int").alias("vb"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), "item_id",
                          F.col("vector").alias("item_vector"), *([F.col("labels").alias("item_labels")] if labelled else []))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"),
                           F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"), "query_id",
                           F.col("vector").alias("query_vector"), *([F.col("labels").alias("query_labels")] if labelled else []))

    if listed is not None:
        barred = listed.groupBy("query_id", F.pmod(F.xxhash64("item_id"), F.lit(n_v)).cast("int").alias("vb")).agg(
            F.collect_set("item_id").alias("barred"))
        right = right.join(barred, ["query_id", "vb"], "left")

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        v = v.sort_values("item_id", kind="stable")
        b = _stacked(v["item_vector"])
        ids, qids = v["item_id"].to_numpy(), q["query_id"].to_numpy()
        alike = _equal_members(q["query_labels"], v["item_labels"]) if "query_labels" in q else None
        out = []
        for low in range(0, len(q), QUERIES_AT_ONCE):
            rows = slice(low, low + QUERIES_AT_ONCE)
            scores = _stacked(q["query_vector"].iloc[rows]) @ b.T
            if alike is not None:
                scores[alike(rows)] = -np.inf
            if "barred" in q:
                for row, items in enumerate(q["barred"].iloc[rows]):
                    if items is not None:
                        scores[row, np.isin(ids, items)] = -np.inf
            out.append(keep(qids[rows], ids, scores))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(run, schema)


SCHEMA = "query_id long, item_id long, score double"


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest scores of each row, ties (to nine places) by smaller column.

    Only scores that reach the ``k``-th best of the first columns are sorted. Scores that are no numbers come last.
    """
    scores = np.where(np.isnan(scores), -np.inf, scores)
    head = scores[:, :max(HEAD, 2 * k)]
    floor = np.partition(head, -k, axis=1)[:, -k] if head.shape[1] > k else np.full(len(scores), -np.inf)
    with np.errstate(invalid="ignore"):
        rows, columns = np.nonzero(scores >= (floor - _SLACK)[:, None])
    order = np.lexsort((columns, -np.round(scores[rows, columns], 9), rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    kept = np.arange(len(rows)) - first[rows] < k
    return rows[kept], columns[kept]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False,
            listed: DataFrame | None = None) -> DataFrame:
    """Exact top ``k`` items per query by dot product, ties (to nine places) by item id.

    ``vectors(item_id, vector)`` and ``queries(query_id, vector)`` hold unit vectors.
    Pairs of ``listed(query_id, item_id)`` are passed over inside the blocks, so
    a query with a long list still gets ``k`` others from one pass. So are pairs that share a
    member of ``labels``, where both tables have that column (arrays).
    """
    def keep(qids, iids, scores):
        if skip_self:
            scores[qids[:, None] == iids[None, :]] = -np.inf
        rows, columns = best_places(scores, k)
        out = pd.DataFrame({"query_id": qids[rows], "item_id": iids[columns], "score": scores[rows, columns]})
        return out[np.isfinite(out["score"])]

    found = _scored_blocks(vectors, queries, keep, SCHEMA, listed, ASKING_PER_BLOCK)
    return top_per_group(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], k)


def above(vectors: DataFrame, queries: DataFrame, floor: float, skip_self: bool = False) -> DataFrame:
    """All query-item pairs whose dot product reaches ``floor``."""
    def keep(qids, iids, scores):
        hit = scores >= floor
        if skip_self:
            hit &= qids[:, None] != iids[None, :]
        at_q, at_i = np.nonzero(hit)
        return pd.DataFrame({"query_id": qids[at_q], "item_id": iids[at_i], "score": scores[hit]})

    return _scored_blocks(vectors, queries, keep, SCHEMA)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as Spark's ``round`` does: half up, by the shortest decimal form of the number."""
    scaled = x * 10.0 ** digits
    whole = np.rint(scaled)
    out = whole / 10.0 ** digits + 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        unsure = np.flatnonzero(~((np.abs(scaled) < 1e9) & (np.abs(scaled - whole) < 0.5 - 1e-6)))
    for i in unsure:
        whole_or_none = not abs(x[i]) < 2 ** 52  # no places left to round
        out[i] = x[i] if whole_or_none else float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _stacked_lists(column: pa.ChunkedArray) -> np.ndarray:
    sizes = pa.compute.list_value_length(column).unique().to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
    flat = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), "float64") for c in column.chunks]
    return np.concatenate(flat).reshape(len(column), -1)


def _reaching(floor: float, digits: int | None, tile: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        same = low == high
        left, right = (rows, rows) if same else (rows.filter(pa.compute.equal(rows["block"], x)) for x in (low, high))
        if not len(left) or not len(right):
            return
        a, b = _stacked_lists(left["vector"]), _stacked_lists(right["vector"])
        (own, lone), (other, none) = ((side["item_id"].fill_null(0).to_numpy(), side["item_id"].is_null().to_numpy()) for side in (left, right))
        for first, second in itertools.product(range(0, len(a), tile[0]), range(0, len(b), tile[1])):
            ones, others = slice(first, first + tile[0]), slice(second, second + tile[1])
            scores = a[ones] @ b[others].T
            n, wide = scores.shape
            at = np.flatnonzero(scores.ravel() >= floor)
            i, j = np.divmod(at, wide)
            if same:
                apart = (own[ones][i] != other[others][j]) | lone[ones][i] | none[others][j]
                at, i, j = at[apart], i[apart], j[apart]
            score = scores.ravel()[at]
            ends = pa.array(np.searchsorted(i, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (
                pa.array(other[others][j], mask=none[others][j]), pa.array(score if digits is None else rounded(score, digits)))]
            yield pa.RecordBatch.from_arrays([pa.array(own[ones], mask=lone[ones]), *lists, pa.array(np.full(n, not same))],
                                             ["one", "others", "scores", "both"])

    return run


def above_each_other(vectors: DataFrame, floor: float, digits: int | None = None) -> DataFrame:
    """``query_id, item_id, score``: all ordered pairs of vectors of different ids whose dot product reaches ``floor``.

    As :func:`above` for vectors that ask for each other, but two blocks meet once and give the pairs of both directions, in
    lists of a ``TILE`` of them at most. ``digits`` rounds the scores after the floor. Rows without a vector reach nothing.
    """
    vectors = vectors.filter("vector IS NOT NULL")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(_blocks(vectors, VECTORS_PER_BLOCK), min(math.ceil(math.sqrt(6 * cores)), _blocks(vectors, 100)))
    own = vectors.select("item_id", "vector", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"))
    meeting = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "item_id", "vector")
    dealt = meeting.repartition(2 * blocks * (blocks + 1), "low", "high")  # few pairs of blocks should share a task
    lists = dealt.groupBy("low", "high").applyInArrow(_reaching(floor, digits, TILE), "one long, others array<long>, scores array<double>, both boolean")
    turns = F.when(F.col("both"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    pairs = lists.withColumn("turned", F.explode(turns)).select("one", "turned", "scores", F.posexplode("others").alias("_at", "other"))
    return pairs.select(F.when(F.col("turned"), F.col("other")).otherwise(F.col("one")).alias("query_id"),
                        F.when(F.col("turned"), F.col("one")).otherwise(F.col("other")).alias("item_id"),
                        F.col("scores")[F.col("_at")].alias("score"))


def coarse_centres(vectors: DataFrame, n: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """``n`` unit centres by spherical k-means, fitted on at most ``sample`` vectors chosen by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("item_id", F.lit(3)), "item_id").limit(sample).select("vector").toPandas()
    x = np.stack(rows["vector"].to_numpy()).astype("float64")
    centres = x[:n].copy()  # in hash order, so as good as drawn at random
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            mean = x[own == c].sum(axis=0)
            length = np.linalg.norm(mean)
            if length > 0:
                centres[c] = mean / length
    return centres


def _with_centres(df: DataFrame, key: str, centres: np.ndarray, many: int) -> DataFrame:
    """``df`` with the numbers of its ``many`` nearest centres, nearest first."""
    def run(batches):
        for part in batches:
            near = np.argsort(-(np.stack(part["vector"].to_numpy()).astype("float64") @ centres.T), axis=1, kind="stable")[:, :many]
            yield part.assign(cells=list(near.astype("int32")))

    kind = df.schema["vector"].dataType.simpleString()
    return df.select(key, "vector").mapInPandas(run, f"{key} long, vector {kind}, cells array<int>")


def _codes(df: DataFrame) -> DataFrame:
    """``item_id, cell, code, scale``: vectors as signed bytes of one scale each."""
    def run(batches):
        for part in batches:
            x = np.stack(part["vector"].to_numpy()).astype("float64")
            scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
            code = [bytes(c) for c in np.round(x / scale[:, None]).astype("int8")]
            yield pd.DataFrame({"item_id": part["item_id"], "cell": [c[0] for c in part["cells"]], "code": code, "scale": scale})

    return df.mapInPandas(run, "item_id long, cell int, code binary, scale double")


def shortlists(vectors: DataFrame, queries: DataFrame, size: int, centres: np.ndarray, probes: int, skip_self: bool = False) -> DataFrame:
    """``query_id, item_id, guess, rank``: per query the ``size`` best rows of its ``probes`` nearest cells by byte codes.

    Vectors lie in the cell of their nearest centre; cells of more than ``VECTORS_PER_BLOCK`` rows are split, and so are the queries that
    probe a cell. Only codes (a byte per component) are shuffled, and ``size`` rows per query and block leave a task.
    """
    cells = durable(_codes(_with_centres(vectors, "item_id", centres, 1)))
    asked = _with_centres(queries, "query_id", centres, probes).select("query_id", "vector", F.explode("cells").alias("cell"))
    asked = durable(asked)
    n_v = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VECTORS_PER_BLOCK).cast("int").alias("_nv"))
    n_q = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).cast("int").alias("_nq"))
    many = durable(n_v.join(n_q, "cell"))

    def dealt(df, key, own, other):
        return df.join(many, "cell").withColumns({
            f"_{own}": F.pmod(F.xxhash64(key), F.col(f"_n{own}")).cast("int"),
            f"_{other}": F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))}).drop("_nv", "_nq")

    left = dealt(cells, "item_id", "v", "q")
    right = dealt(asked, "query_id", "q", "v").withColumnsRenamed({"cell": "cell_", "_v": "_v_", "_q": "_q_"})

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "guess": []})
        v = v.sort_values("item_id")
        code = np.frombuffer(b"".join(v["code"]), "int8").reshape(len(v), -1).astype("float32")
        ids, scale = v["item_id"].to_numpy(), v["scale"].to_numpy()
        found = []
        for low in range(0, len(q), QUERIES_AT_ONCE):
            part = q.iloc[low:low + QUERIES_AT_ONCE]
            qids = part["query_id"].to_numpy()
            guess = (np.stack(part["query_vector"].to_numpy()).astype("float32") @ code.T).astype("float64") * scale
            if skip_self:
                guess[qids[:, None] == ids[None, :]] = -np.inf
            rows, columns = best_places(guess, size)
            found.append(pd.DataFrame({"query_id": qids[rows], "item_id": ids[columns], "guess": guess[rows, columns]}))
        out = pd.concat(found, ignore_index=True)
        return out[np.isfinite(out["guess"])]

    right = right.withColumnRenamed("vector", "query_vector")
    found = left.groupBy("cell", "_v", "_q").cogroup(right.groupBy("cell_", "_v_", "_q_")).applyInPandas(
        run, "query_id long, item_id long, guess double")
    return top_per_group(found, ["query_id"], [F.desc("guess"), F.asc("item_id")], size)


def nearest_by_centres(vectors: DataFrame, queries: DataFrame, k: int, centres: int = 64, probes: int = 8, shortlist: int | None = None,
                       skip_self: bool = False) -> DataFrame:
    """Approximate top ``k``: cells of trained centres are probed by byte codes, then a short list is scored exactly.

    ``shortlist`` (4 k by default) rows per query are compared in full precision. How many cells must be probed depends on how
    far the vectors form groups; :func:`recall` measures it.
    """
    near = durable(shortlists(vectors, queries, shortlist or 4 * k, coarse_centres(vectors, centres), probes, skip_self))
    pairs = near.select("query_id", "item_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id").join(
        vectors.select("item_id", F.col("vector").alias("_v")), "item_id")
    product = F.zip_with("_q", "_v", lambda a, b: a.cast("double") * b.cast("double"))
    scored = pairs.select("query_id", "item_id", F.aggregate(product, F.lit(0.0), lambda s, x: s + x).alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact neighbours that the approximate list holds."""
    hits = exact.join(approximate.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_exact"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
