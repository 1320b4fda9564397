"""Near-duplicate vectors by robust-pruned flat graphs over overlapping cluster shards.

Equal unit vectors of a label (to twelve decimals) are one node with a weight, as ties would fill each other's lists
and hide the rest; the others of a group are links of each member. Nodes of one label (and dimension) are given to their three nearest clusters and to every other whose centre is
about as near as the nearest; centres are fitted on a bounded sample. A shard of more than ``BLOCK`` vectors is split by hash, and its blocks meet
pairwise. Each block gets a graph: candidate neighbours pruned so that none is much nearer to a kept neighbour
than to the node. The adjacency lists of a vector from all its shards are united. Queries walk a block's
graph greedily from medoids of its parts and then spread from every hit over neighbours within the range. Hits are
verified in double precision. A pair found in several shards counts in the first shard both share.
Tasks return a count and a local root per vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch, components
from larkfield.llm.quality import sized

SAMPLE = 4000
SHARD, BLOCK = 1200, 1500
CLUSTERS = 128
LEAST_HOMES, MARGIN = 3, 0.06
DEGREE, MEDOIDS, BEAM, STEPS, SLACK = 24, 16, 48, 48, 0.08


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one as bytes of doubles, and a key that equal ones share; null for those that can't be compared."""
    for batch in batches:
        out, sizes, keys = [], [], []
        for value in batch.column(2):
            v = value.as_py()
            v = None if v is None or any(x is None for x in v) else np.array(v, np.float64)
            top = np.abs(v).max() if v is not None and len(v) else 0.0
            if v is None or not np.isfinite(top) or top == 0:
                out.append(None)
                sizes.append(None)
                keys.append(None)
                continue
            v = v / top
            v = v / np.sqrt((v ** 2).sum())
            out.append(v.tobytes())
            keys.append(xxhash.xxh3_128_digest((np.round(v, 12) + 0.0).tobytes()))
            sizes.append(len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(out, pa.binary()),
                                          pa.array(keys, pa.binary())], ["vec", "label", "size", "unit", "key"])


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums ** 2).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _centres(table: pa.Table) -> pa.Table:
    centres = fit_centres(_matrix(table.column("unit")), int(table.column("k")[0].as_py()))
    return pa.table({"label": table.column("label").slice(0, 1), "size": table.column("size").slice(0, 1),
                     "centres": pa.array([centres.tobytes()], pa.binary())})


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        homes = []
        for unit, centres in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            v = np.frombuffer(unit, np.float64)
            near = np.frombuffer(centres, np.float64).reshape(-1, len(v)) @ v
            homes.append(np.flatnonzero(near >= min(near.max() - MARGIN, np.sort(near)[-LEAST_HOMES:].min())).tolist())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), batch.column(5), pa.array(homes, pa.list_(pa.int32()))],
                                         ["vec", "label", "size", "unit", "weight", "homes"])


def robust_prune(sims: np.ndarray, degree: int, alpha: float = 1.2) -> np.ndarray:
    """Neighbours of every row: nearest first, without those that a kept one is nearer to by ``alpha``; -1 fills up."""
    n = len(sims)
    width = min(4 * degree, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if not width:
        return out
    apart = 2 - 2 * sims
    np.fill_diagonal(apart, np.inf)
    near = np.argpartition(apart, width - 1, axis=1)[:, :width]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(apart, near, axis=1), axis=1, kind="stable"), axis=1)
    alive = np.ones((n, width), bool)
    rows, filled = np.arange(n), np.zeros(n, np.int64)
    for _ in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        picked = near[rows, first]
        out[rows[some], filled[some]] = picked[some]
        filled += some
        own = np.take_along_axis(apart, near, axis=1)
        alive &= ~((alpha * np.maximum(apart[picked[:, None], near], 0) <= own) & some[:, None])
        alive[rows, first] = False
    return out


def _graph(table: pa.Table) -> pa.Table:
    """Adjacency lists of a block, as vector ids; a ring keeps the graph connected."""
    vecs = table.column("vec").to_numpy()
    x = _matrix(table.column("unit"))
    sims = x @ x.T
    near = robust_prune(sims.copy(), DEGREE)
    ring = np.roll(np.arange(len(vecs)), -1)
    # Edges go both ways; of those that come back, a node keeps its nearest.
    source, target = np.repeat(np.arange(len(vecs)), near.shape[1])[near.ravel() >= 0], near.ravel()[near.ravel() >= 0]
    order = np.lexsort((-sims[source, target], target))
    firsts = np.searchsorted(target[order], np.arange(len(vecs) + 1))
    back = [source[order[a:min(b, a + 2 * DEGREE)]] for a, b in zip(firsts, firsts[1:])]
    lists = [vecs[np.unique(np.concatenate([row[row >= 0], back[i], ring[i:i + 1]]))].tolist() for i, row in enumerate(near)]
    return pa.table({"vec": table.column("vec"), "near": pa.array(lists, pa.list_(pa.int64()))})


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, own_rows: np.ndarray | None = None) -> np.ndarray:
    """Which rows of ``x`` each query reaches with at least ``least``, by a greedy walk from medoids and spreading.

    ``own_rows`` are the queries' own places in the graph, if they are in it: spreading starts there too.
    """
    n, m = len(x), len(queries)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    hits = np.zeros((m, n), bool)
    rows = np.arange(m)
    medoids = np.unique((x @ fit_centres(x, MEDOIDS, 3).T).argmax(axis=0))
    beam = np.full((m, BEAM), n)
    sims = np.full((m, BEAM), -2.0)
    open_ = np.zeros((m, BEAM), bool)
    beam[:, :len(medoids)], sims[:, :len(medoids)], open_[:, :len(medoids)] = medoids, queries @ x[medoids].T, True
    seen[:, medoids] = True
    hits[:, medoids] = sims[:, :len(medoids)] >= least
    for _ in range(STEPS):
        best = np.where(open_, sims, -3).argmax(axis=1)
        if not open_[rows, best].any():
            break
        now = np.where(open_[rows, best], beam[rows, best], n)
        open_[rows, best] = False
        new = np.where(now[:, None] < n, graph[np.minimum(now, n - 1)], n)
        new = np.where(seen[rows[:, None], new], n, new)
        seen[rows[:, None], new] = True
        own = np.where(new < n, np.einsum("qd,qrd->qr", queries, x[np.minimum(new, n - 1)]), -2)
        hit_rows, hit = np.nonzero(own >= least)
        hits[hit_rows, new[hit_rows, hit]] = True
        beam, sims, open_ = (np.concatenate(p, axis=1) for p in ((beam, new), (sims, own), (open_, new < n)))
        keep = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
        beam, sims, open_ = (np.take_along_axis(p, keep, axis=1) for p in (beam, sims, open_))
    if own_rows is not None:
        seen[rows, own_rows] = True
        hits[rows, own_rows] = True
    for start in range(0, m, 256):  # spread from hits, level by level
        part = slice(start, start + 256)
        q, node = np.nonzero(hits[part])
        while len(q):
            new = graph[node]
            q = np.repeat(q, new.shape[1])
            new = new.ravel()
            fresh = ~seen[part][q, new]
            pairs = np.unique(q[fresh] * (n + 1) + new[fresh])
            q, new = pairs // (n + 1), pairs % (n + 1)
            seen[part][q, new] = True
            own = np.einsum("pd,pd->p", queries[part][q], x[new])
            near = own >= least
            q, node = q[near], new[near]
            hits[part][q, node] = True
    return hits


def _links(least: float):
    def run(key, table):
        cluster, first, second = (k.as_py() for k in key[2:5])
        vecs, block, weight = (table.column(c).to_numpy() for c in ("vec", "block", "weight"))
        x = _matrix(table.column("unit"))
        order = np.lexsort((vecs, block))
        vecs, block, weight, x = vecs[order], block[order], weight[order], x[order]
        homes = [set(h) for h in table.column("homes").take(pa.array(order)).to_pylist()]
        lists = table.column("near").take(pa.array(order)).to_pylist()
        inside = np.flatnonzero(block == second)
        at = {v: i for i, v in enumerate(vecs[inside].tolist())}
        near = [[at[v] for v in lists[i] if v in at] for i in inside]
        graph = np.full((len(inside), max(map(len, near), default=1) or 1), len(inside))
        for i, own in enumerate(near):
            graph[i, :len(own)] = own
        asking = np.flatnonzero(block == first)
        own = np.arange(len(asking)) if first == second else None
        found = range_search(x[inside], graph, x[asking], least - SLACK, own) if len(inside) and len(asking) else np.zeros((len(asking), len(inside)), bool)
        q, hit = np.nonzero(found)
        exact = np.einsum("pd,pd->p", x[asking[q]], x[inside[hit]]) >= least
        found[:] = False
        found[q[exact], hit[exact]] = True
        if first == second:
            found |= found.T
            np.fill_diagonal(found, False)
        for other in {h for own in homes for h in own if h < cluster}:
            has = np.array([other in own for own in homes])
            found &= ~(has[asking][:, None] & has[inside][None, :])
        count, root = np.zeros(len(vecs), np.int64), np.arange(len(vecs))
        count[asking] += found @ weight[inside]
        if first != second:
            count[inside] += weight[asking] @ found
        q, hit = np.nonzero(found)
        a, b = asking[q], inside[hit]
        while len(a):  # smallest place reachable
            before = root.copy()
            least_root = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least_root)
            np.minimum.at(root, b, least_root)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(count)
        return pa.table({"vec": pa.array(vecs[some]), "n": pa.array(count[some]), "root": pa.array(vecs[root[some]])})

    return run


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least: float = 0.93) -> DataFrame:
    """``<id>, n_links, component_id, kept``, one row per vector id.

    Links join vectors of equal, non-null labels and equal dimension whose cosine in double precision is at least
    ``least``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Of rows that
    repeat an id the smallest (label, vector) counts; unit vectors equal to twelve decimals count as the one with the smallest id; each row without an id is returned alone. The search is
    approximate: ``true_links`` measures what it misses. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    kind, label_kind = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    named = rows.where("vec is not null").groupBy("vec").agg(F.min(F.struct("label", "v")).alias("row")).select("vec", "row.label", "row.v")
    units = scratch.keep(named.mapInArrow(_units, f"vec long, label {label_kind}, size int, unit binary, key binary"), "units")
    same = units.where("unit is not null and label is not null").groupBy("label", "size", "key").agg(F.min("vec").alias("vec"), F.count("*").alias("weight"))
    same = scratch.keep(same, "same")
    usable = scratch.keep(units.select("vec", "label", "size", "unit").join(same.select("vec", "weight"), "vec"), "nodes")
    members = scratch.keep(units.select("vec", "label", "size", "key"), "members")
    scratch.drop("units")
    counts = usable.groupBy("label", "size").count()
    ranked = usable.withColumn("rank", F.row_number().over(Window.partitionBy("label", "size").orderBy(F.xxhash64("vec"), "vec")))
    # A vector has LEAST_HOMES homes, so shards keep about SHARD vectors, copies included.
    k = F.least(F.ceil(F.col("count") * LEAST_HOMES / SHARD), F.lit(CLUSTERS))
    sample = ranked.where(F.col("rank") <= SAMPLE).join(counts, ["label", "size"]).select("label", "size", "unit", k.alias("k"))
    centres = scratch.keep(sample.groupBy("label", "size").applyInArrow(_centres, f"label {label_kind}, size int, centres binary"), "centres")
    placed = usable.join(sized(centres), ["label", "size"]).select("vec", "label", "size", "unit", "centres", "weight")
    placed = scratch.keep(placed.mapInArrow(_homes, f"vec long, label {label_kind}, size int, unit binary, weight long, homes array<int>"), "homes")
    scratch.drop("nodes")
    spread = placed.withColumn("cluster", F.explode("homes"))
    blocks = spread.groupBy("label", "size", "cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = scratch.keep(spread.join(blocks, ["label", "size", "cluster"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")), "shards")
    graphs = spread.groupBy("label", "size", "cluster", "block").applyInArrow(_graph, "vec long, near array<long>")
    graphs = scratch.keep(graphs.groupBy("vec").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graphs")
    # Block b is asked by the blocks before it and by itself.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = spread.join(graphs, "vec").withColumn("other", other).select(
        "label", "size", "cluster", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "vec", "unit", "weight", "homes", "near")
    found = scratch.keep(pairs.groupBy("label", "size", "cluster", "first", "second").applyInArrow(_links(least), "vec long, n long, root long"), "found")
    sums = found.groupBy("vec").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")), scratch, "vectors")
    roots = roots.withColumnRenamed("node", "vec")
    # Every member of a group has the links of its node and the rest of the group.
    groups = same.where("weight > 1").join(sums, "vec", "left").join(roots, "vec", "left").select(
        "label", "size", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("group_n"), F.coalesce("root", "vec").alias("group_root"))
    groups = scratch.keep(groups, "groups")
    out = members.join(sums, "vec", "left").join(roots, "vec", "left").join(sized(groups), ["label", "size", "key"], "left")
    out = out.select("vec", F.coalesce("group_n", "n").alias("n"), F.coalesce("group_root", "root").alias("root"))
    alone = rows.where("vec is null").select("vec")
    out = out.select("vec", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("root", "vec").alias("component_id")).unionByName(
        alone.select("vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id")))
    return out.select(F.col("vec").cast(kind).alias(id_col), "n_links", F.col("component_id").cast(kind).alias("component_id"),
                      (F.col("vec") == F.col("component_id")).alias("kept"))


def true_links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
               every: int = 100, block: int = 5000) -> DataFrame:
    """``<id>, n_true``: exact link counts of the stated queries (ids divisible by ``every``) against all rows, in blocks of queries."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    units = rows.mapInArrow(_units, f"vec long, label {rows.schema['label'].dataType.simpleString()}, size int, unit binary, key binary")
    usable = units.where("unit is not null and label is not null and vec is not null")
    asked = usable.where(F.col("vec") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec"), F.lit(blocks)) == b).toArrow()  # about ``block`` vectors
        names = mine.column("vec").to_numpy()
        labels = mine.column("label").to_pylist()
        x = [np.frombuffer(u, np.float64) for u in mine.column("unit").to_pylist()]

        def count(batches, names=names, labels=labels, x=x):
            for batch in batches:
                sums: dict[int, int] = {}
                for label in set(batch.column(1).to_pylist()):
                    for size in set(batch.column(2).to_pylist()):
                        at = [i for i, (a, s) in enumerate(zip(labels, x)) if a == label and len(s) == size]
                        own = [i for i, (a, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if a == label and s == size]
                        if at and own:
                            near = np.stack([x[i] for i in at]) @ _matrix(batch.column(3).take(pa.array(own))).T >= least
                            near &= names[at][:, None] != batch.column(0).to_numpy()[own][None, :]
                            for i, n in zip(at, near.sum(axis=1).tolist()):
                                sums[int(names[i])] = sums.get(int(names[i]), 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["vec", "n"])

        part = usable.mapInArrow(count, "vec long, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("vec").alias(id_col)).agg(F.sum("n").alias("n_true"))
