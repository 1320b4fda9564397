"""Item neighbours, counted terms, probed cells and co-occurrence against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfield.operators import dense, neighbours
from larkfield.operators import text_index as ti
from larkfield.functions import text as tx


def unit_rows(seed, n):
    """Items of three word families with shared common words, copies, a lone item and one without partners."""
    rng = random.Random(seed)
    texts = [[f"f{i % 3}w{rng.randrange(30)}" for _ in range(rng.randint(1, 12))] + rng.choices(["the", "of", "and"], k=3) for i in range(n)]
    texts += [texts[0]] * 25 + [["alone"], ["the"]]
    df = Counter(w for t in texts for w in set(t))
    rows = []
    for i, text in enumerate(texts):
        raw = {w: c * math.log(1 + len(texts) / df[w]) for w, c in Counter(text).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        rows += [(i, w, x / norm) for w, x in raw.items()]
    return rows


def brute_neighbours(rows, k):
    vectors = {}
    for i, w, x in rows:
        vectors.setdefault(i, {})[w] = x
    out = {}
    for i, v in vectors.items():
        scored = [(round(sum(x * u[w] for w, x in v.items() if w in u), 9), j) for j, u in vectors.items() if j != i and set(u) & set(v)]
        out[i] = sorted(scored, key=lambda r: (-r[0], r[1]))[:k]
    return out


@pytest.mark.parametrize("seed, k, block", [(1, 5, 1000), (2, 5, 17), (3, 30, 9)])
def test_item_neighbours_are_exact(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(neighbours, "TERM_RUN", 3)
    monkeypatch.setattr(neighbours, "ASKING", 20)
    rows = unit_rows(seed, 120)
    found = neighbours.nearest_items(spark.createDataFrame(rows, "item_id long, term string, weight double"), k, block)
    got = {}
    for r in found.orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((round(r.cosine, 9), r.neighbour))
    want = {i: v for i, v in brute_neighbours(rows, k).items() if v}
    assert set(got) == set(want)
    for i in want:
        assert [s for s, _ in got[i]] == pytest.approx([s for s, _ in want[i]], abs=2e-9)
        least = want[i][-1][0]
        assert {j for s, j in got[i] if s > least + 1e-8} == {j for s, j in want[i] if s > least + 1e-8}


def test_items_travel_only_where_they_can_gain(spark):
    """Two families without a shared word: no item is sent to the other family's block."""
    tops = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (1, 3, 0.8), (1, 4, 0.7)], "block long, place int, top double")
    rows = [(7, [1, 2], [0.6, 0.8], 0.1, 0), (8, [2, 3], [0.9, 0.4], 0.3, 0), (9, [3], [0.2], 0.3, 0)]
    asking = spark.createDataFrame(rows, "item_id long, places array<int>, weights array<double>, floor double, block long")
    assert [tuple(r) for r in neighbours.routes(asking, tops).collect()] == [(8, 1)]


@pytest.mark.parametrize("lengths", [(0, 1, 2, 3, 5), (1, 1, 1, 1, 1), (2, 0, 2, 0, 1), (7, 4, 1, 2, 3)])
def test_repeated_parts_count_like_written_ones(spark, lengths):
    parts = [[f"{name}{i}" for i in range(n)] for name, n in zip("abcde", lengths)]
    times = [6, 5, 4, 2, 2]
    written = [w for p, n in zip(parts, times) for w in p * n]
    want = Counter(["_".join(written[i:i + k]) for k in (1, 2, 3) for i in range(len(written) - k + 1)])
    df = spark.createDataFrame([(1, *parts)], "k int, a array<string>, b array<string>, c array<string>, d array<string>, e array<string>")
    pairs = [ti.repeated(F.col(c), n) for c, n in zip("abcde", times)]
    row = df.select("k", F.concat(*[t for t, _ in pairs]).alias("t"), F.concat(*[n for _, n in pairs]).alias("n"))
    sizes = F.concat(*[F.slice("n", F.lit(1), F.greatest(F.size("n") - j, F.lit(0))) for j in range(3)])
    got = ti.term_rows(ti.counted(row, ["k"], tx.with_ngrams(F.col("t")), sizes), "k").collect()
    assert {r.term: r.tf for r in got} == want


def test_counts_inside_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices("abcdefgh", k=n)) for i, n in enumerate([0, 1, 2, 50, 5000])] + [(9, None)]
    counted = ti.counted(spark.createDataFrame(rows, "k int, w array<string>"), ["k"], F.col("w"))
    got = {r.k: (r["size"], {c.term: c.tf for c in r.counts or []}) for r in counted.collect()}
    assert all(got[k] == (len(w), Counter(w)) for k, w in rows if w is not None) and not got[9][1]


def test_probed_cells_find_groups_with_few_probes(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((20, 24))
    x = np.repeat(centre, 30, axis=0) + 0.25 * rng.standard_normal((600, 24))
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    asked = df.withColumnRenamed("item_id", "query_id").filter("query_id % 10 = 0")
    near = dense.nearest_by_centres(df, asked, 10, centres=20, probes=4, skip_self=True)
    exact = dense.nearest(df, asked, 10, skip_self=True)
    scores = lambda d: {q: sorted(round(r.score, 6) for r in d if r.query_id == q) for q in {r.query_id for r in d}}
    got, want = scores(near.collect()), scores(exact.collect())  # copies tie, so scores are compared
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(len(set(want[q])) for q in want)
    assert hits >= 0.9


def test_two_blocks_meet_once_for_the_items_of_both(spark, monkeypatch):
    """Terms in dense columns and in lists, repeated entries, many chunks: each side gets its best rows above its floors."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    m = rng.random((70, 25)) * (rng.random((70, 25)) < np.linspace(0.02, 0.9, 25))
    m[:2] = 0
    m[40:45] = m[3]
    cosines = m[:30] @ m[30:].T
    floors = np.where(np.arange(70) % 3 == 0, 0.0, 1.5)

    def table(rows, end):
        places = [np.repeat(np.flatnonzero(m[i]), 2).astype(np.int32) for i in rows]  # every entry in two halves
        return pa.table({f"item_id{end}": pa.array(rows), f"places{end}": pa.array(places, pa.list_(pa.int32())), f"floor{end}": floors[rows],
                         f"weights{end}": pa.array([m[i][p] / 2 for i, p in zip(rows, places)], pa.list_(pa.float64()))})

    for cells, share, at_once in ((1024, 1 / 150, 7), (120, 0.01, 30), (0, 0.0, 256), (1024, 0.0, 1)):
        monkeypatch.setattr(neighbours, "CELLS", cells)
        monkeypatch.setattr(neighbours, "SHARE", share)
        out = neighbours._meeting(4, at_once)(table(np.arange(30), ""), table(np.arange(30, 70), "_")).to_pylist()
        got = {}
        for r in out:
            got.setdefault(r["item_id"], []).append((round(r["cosine"], 9), r["neighbour"]))
        for i in range(70):
            scores = [(round(float(s), 9), j) for j, s in (zip(range(30, 70), cosines[i]) if i < 30 else zip(range(30), cosines[:, i - 30]))]
            want = sorted((x for x in scores if x[0] > 0 and x[0] >= floors[i]), key=lambda x: (-x[0], x[1]))[:4]
            assert sorted(got.get(i, []), key=lambda x: (-x[0], x[1])) == want


def test_blocks_are_equal_and_rows_without_an_id_are_no_items(spark):
    """One pivot takes nearly all items, yet no block holds more than asked for; a missing id is nobody's neighbour."""
    rows = [(i, "a", 0.6) for i in range(90)] + [(i, f"b{i}", 0.8) for i in range(90)] + [(None, "a", 1.0), (200, "c", 1.0)]
    weights = spark.createDataFrame(rows, "item_id long, term string, weight double")
    sizes = neighbours._in_blocks(neighbours.sparse_vectors(weights.filter("item_id IS NOT NULL")), 13).groupBy("block").count().collect()
    assert sum(r["count"] for r in sizes) == 91 and max(r["count"] for r in sizes) <= 13
    found = neighbours.nearest_items(weights, 3, 13).collect()
    assert {r.item_id for r in found} == set(range(90))
    assert all(sorted(r.neighbour for r in found if r.item_id == i) == [j for j in range(5) if j != i][:3] for i in range(90))


def test_long_items_lie_in_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ENTRIES", 100)
    rows = [(i, f"w{j}", 0.1) for i in range(60) for j in range(3 if i < 50 else 90)]
    vectors = neighbours.sparse_vectors(spark.createDataFrame(rows, "item_id long, term string, weight double"))
    sizes = neighbours._in_blocks(vectors, 1000).groupBy("block").agg(F.sum(F.size("places")).alias("entries"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in sizes) == 60 and max(r.entries for r in sizes) <= 400 and len(sizes) > 5


def test_blocks_that_meet_in_turns_leave_only_the_best_rows(spark, tmp_path, monkeypatch):
    """Many small turns give the same rows, and the tables made on the way are gone."""
    from larkfield import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    rows = unit_rows(5, 90)
    weights = session.durable(spark.createDataFrame(rows, "item_id long, term string, weight double"))
    whole = neighbours.nearest_items(weights, 4, 1000).collect()
    before = set(tmp_path.iterdir())
    found = neighbours.nearest_items(weights, 4, 30, copies=1, spent=[weights])
    left = set(tmp_path.iterdir()) - before
    assert len(left) == 1  # the best rows of the last turn
    got = found.collect()
    assert sorted((r.item_id, r.rank, round(r.cosine, 8)) for r in got) == sorted((r.item_id, r.rank, round(r.cosine, 8)) for r in whole)
    assert len(before - set(tmp_path.iterdir())) == 1  # the weights


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    """A join is written twice, each time without what its shuffle left on disk; the session's setting stays."""
    from larkfield.session import drop, durable
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("n"))
    tables = [durable(rows), durable(rows)]
    assert [sorted(map(tuple, t.collect())) for t in tables] == [sorted(map(tuple, rows.collect()))] * 2
    assert spark.conf.get(name, None) == before
    drop(*tables)
    with pytest.raises(Exception):
        tables[0].collect()


def test_turns_of_blocks_change_no_similar_items_and_no_sums(spark, tmp_path, monkeypatch):
    """Small blocks in many turns; the baskets and lists sent to them are gone afterwards."""
    from larkfield import session
    from larkfield.operators import cf
    rng = random.Random(8)
    pairs = spark.createDataFrame(sorted({(u, rng.randrange(40)) for u in range(60) for _ in range(8)}), "user_id long, item_id long")
    whole = sorted(map(tuple, cf.item_similarity(pairs, 6).collect()))
    shown = sorted(map(tuple, cf.recommend(pairs, cf.item_similarity(pairs, 6), 3).collect()))
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    turns = []
    run = cf.in_turns
    monkeypatch.setattr(cf, "in_turns", lambda parts, block, n, *a: turns.append(n) or run(parts, block, n, *a))
    sim = cf.item_similarity(pairs, 6, entries=1200, copies=2)
    assert sorted(map(tuple, sim.collect())) == whole
    assert sorted(map(tuple, cf.recommend(pairs, sim, 3, entries=100, copies=2).collect())) == shown
    assert min(turns) > 1
    with_baskets = [d for d in tmp_path.iterdir() if {"e"} == set(spark.read.parquet(str(d)).columns)]
    assert not with_baskets


def test_copies_of_label_runs_are_not_broadcast(spark):
    from larkfield.operators import evaluation as ev
    items = spark.createDataFrame([(i, i % 3) for i in range(90)], "item_id long, label int")
    found = ev.label_pairs(items, items.withColumnRenamed("item_id", "query_id"))
    assert sum(len(r.ids) for r in found.collect()) == 90 * 30
    assert "rightHint=(strategy=merge)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_not_shuffled_to_meet_the_gate(spark):
    from larkfield.operators import search
    scores = spark.range(200).select((F.col("id") % 20).alias("query_id"), F.col("id").alias("item_id"), ((F.col("id") % 20) / 20 + 0.001).alias("score"))
    found = search.gated(scores, 0.5, 0.4, scores.filter("query_id = 9").select("query_id"))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id for r in found.collect()} == {9, *range(10, 20)}


def test_signals_of_items_and_queries_that_come_twice(spark):
    """Joint sums give what the channels give on their own, pair by pair."""
    from larkfield.operators import search
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=4)), rng.sample(words, 2), rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), " ".join(rng.choices(words, k=12))) for i in range(50)]
    docs = spark.createDataFrame(docs + docs[:5] + [(None, *docs[6][1:])], "item_id long, title string, topics array<string>, category string, type string, description string")
    asked = [(q, " ".join(rng.choices(words, k=3)) + (" en" if q % 2 else " w999")) for q in range(6)]
    asked = spark.createDataFrame(asked + asked[:2], "query_id long, query string")
    lex = search.Lexicon(categories=("en", "fr"), max_features=500)
    key = ["query_id", "item_id"]
    got = {}
    for r in search.signals(docs, asked, lex, 2, char=True).collect():
        got.setdefault((r.query_id, r.item_id), []).append(r)
    for name, own in (("tfidf", search.tfidf_scores(docs, asked, lex)), ("bm25", search.bm25_scores(docs, asked, lex)), ("char", search.char_scores(docs, asked)),
                      ("topic_jaccard", search.topic_scores(docs, asked, lex)), ("topic_contain", search.topic_scores(docs, asked, lex)), ("title_overlap", search.title_scores(docs, asked, lex))):
        want = {(r.query_id, r.item_id): r[name] for r in own.select(*key, name).collect() if r.item_id is not None}
        if name != "char":
            assert set(want) <= set(got), name
        for pair, rows in got.items():
            assert [r[name] for r in rows] == pytest.approx([want.get(pair, 0.0)] * len(rows), abs=1e-12), (name, pair)
    assert all(len(rows) == (2 if i < 5 else 1) * (2 if q < 2 else 1) for (q, i), rows in got.items())
    best = search.lexical_search(docs, asked, lex, 3).collect()
    assert {(r.query_id, r.rank) for r in best} >= {(q, 1) for q in range(6)}
