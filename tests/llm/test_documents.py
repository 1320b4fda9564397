"""Near-duplicates, repeated passages, packing, leaks and the pipeline against brute force, and their odd inputs."""

import sys
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from larkfield.llm import decontaminate, near_dedup, packing, suffixes
from larkfield.llm.common import Scratch, WordHashes, components

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASH = ("doc", "node", "size", "key", "starts", "label", "length", "count")


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnopq") * rng.randint(1, 3) + rng.choice("rstuvw") for _ in range(n))


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


def near_copies(rng, n_groups=3, size=30):
    rows, at = [], 100
    for _ in range(n_groups):
        base = words(rng, 120).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 12)):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((at, " ".join(own)))
            at += 1
    return rows


def brute_components(rows, n, percent=80):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root) if d is not None))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = near_copies(rng) + [(1, "one"), (2, "ONE"), (3, None), (4, ""), (5, " \t\n"), (6, words(rng, 9000)), (7, "one two"), (7, words(rng, 40)),
                               (8, "É a b"), (9, "é a b")]
    rows += [(99, rows[0][1])] * 2
    got = near_dedup.near_duplicates(documents(spark, [*rows, (None, rows[3][1])]), shingle=n).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None] or len(got) == len(rows) + 1


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).collect() == []
    assert near_dedup.near_duplicates(documents(spark, [(1, None)])).collect()[0].component_id == 1


def test_pruning_keeps_likely_pairs():
    least = near_dedup.least_matches(200, 20, 0.8, 1e-6)
    assert least == sorted(least) and least[0] > 0
    rng = np.random.default_rng(1)
    sure = (rng.random((20_000, 200)) < 0.8).reshape(20_000, 10, 20).sum(axis=2).cumsum(axis=1)
    assert (sure >= np.array(least)).all(axis=1).mean() > 0.9999
    assert not (np.cumsum([4] * 10) >= np.array(least)).all()


def test_components_are_smallest_nodes(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (70, 100), (9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 70: 50, 100: 50}


def brute_repeats(rows, length):
    first, own = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = own[doc] = (text or "").encode().lower().split()
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i:i + length]), doc)
    found = {}
    for doc, w in own.items():
        cover = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] != doc:
                cover |= set(range(i, i + length))
        if cover:
            found[doc] = cover
    return found


def repeats_corpus():
    rng = random.Random(5)
    shared = [words(rng, n) for n in (49, 50, 51, 60, 90, 200)]
    rows = [(i, " ".join([words(rng, rng.randint(0, 60)), rng.choice(shared), words(rng, rng.randint(0, 60)), rng.choice(shared).upper()])) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "a " * 300), (53, "b " * 10 + "a " * 200), (54, shared[4]), (None, shared[4]), (55, words(rng, 4000))]


def test_repeated_passages_equal_brute_force(spark):
    rows = repeats_corpus()
    got = {r.doc_id: {w for s in r.spans for w in range(s.first_word, s.last_word + 1)} for r in suffixes.repeated_passages(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows, 50)
    out = suffixes.repeated_passages(documents(spark, rows)).collect()
    assert all(r.kept_in and max(r.kept_in) < r.doc_id for r in out)


def test_cut_repeats_keeps_rows_and_columns(spark):
    rows = repeats_corpus() + [(54, "short"), (56, "no repeat here")]
    docs = documents(spark, rows)
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    out = cut.collect()
    assert not brute_repeats([(r.doc_id, r.text) for r in out if r.doc_id not in (52, 53)], 50)
    texts = {r.doc_id: r.text for r in out}
    assert texts[50] is None and texts[51] == "" and texts[56] == "no repeat here" and texts[55] == dict(rows)[55]
    assert suffixes.cut_repeats(documents(spark, [])).count() == 0


def test_runs_of_starts():
    assert suffixes.runs_of(np.array([3, 4, 5, 60, 55]), 50) == [(3, 110)] and suffixes.runs_of(np.array([], int), 50) == []
    assert suffixes.runs_of(np.array([0, 51]), 50) == [(0, 50), (51, 101)]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sab1.,é 　\x1c\x85"))), max_size=60))
def test_chunks_give_the_tokenizers_ids(tokenizer, text):
    got = np.frombuffer(packing.piece_encoder().ids(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    used = {}
    for times, copies in packing.plan_bins(counts, 64):
        assert copies > 0 and sum(n * k for n, k in times.items()) <= 64
        for n, k in times.items():
            used[n] = used.get(n, 0) + k * copies
    assert used == counts


def test_plan_replaces_the_smallest_by_two():
    # Greedy takes 60 + 30; two of 20 fill the widened gap of 40 exactly.
    assert packing.plan_bins({60: 1, 30: 1, 20: 2}, 100)[0] == ({60: 1, 20: 2}, 1)


def test_pack_places_every_token(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 5, 80, 400]))) for i in range(60)] + [(70, None), (71, ""), (72, words(rng, 3000)), (None, "no id"), (73, "x")] + [(73, "x")] * 3
    got = packing.pack(documents(spark, rows)).collect()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    pieces = {}
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 2048
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in pieces.values():
        ends = [a + b for a, b in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r.length for r in got)
    assert total == sum(len(ids[d]) for d, _ in rows) and len(pieces) <= -(-total // 2048) + 1
    assert packing.pack(documents(spark, [])).count() == 0


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_common_subsequence(a, b):
    assert decontaminate.common_subsequence(a, b) == plain_common(a, b)


def test_leaks_exact_and_paraphrased(spark):
    rng = random.Random(11)
    items = [(i, words(rng, rng.randint(15, 60))) for i in range(30)] + [(90, None), (91, ""), (92, words(rng, 150))]
    texts = dict(items)
    rows = [(i, words(rng, rng.randint(0, 400))) for i in range(60)]
    rows += [(100 + i, f"{words(rng, 90)} {texts[i].upper()}. {words(rng, 50)}") for i in range(10)]
    loose = texts[12].split()
    rows += [(200, words(rng, 70) + " " + " ".join(w if k % 5 else words(rng, 1) for k, w in enumerate(loose))), (201, None), (202, ""), (203, texts[92]),
             (204, "der " * 400), (None, texts[3])]
    items_df = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("doc_id"), F.lit("x").alias("part"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_passages(documents(spark, rows), items_df).collect()}
    assert got == {(100 + i, i) for i in range(10)} | {(200, 12), (203, 92), (None, 3)}
    assert decontaminate.leaked_passages(documents(spark, rows), items_df.limit(0)).count() == 0
    assert decontaminate.leaked_passages(documents(spark, []), items_df).count() == 0


@pytest.mark.parametrize("n", [1000, 3000])
def test_every_verbatim_copy_is_found(spark, n):
    rng = random.Random(n)
    items = [(i, words(rng, 50)) for i in range(n)]
    rows = [(i, f"{words(rng, 15)} {text} {words(rng, 15)}") for i, text in items] + [(n + i, words(rng, 80)) for i in range(100)]
    got = decontaminate.leaked_passages(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(n)}


def test_answers_lower_the_needed_share(spark):
    rng = random.Random(2)
    item = words(rng, 40).split()
    loose = " ".join(w if k % 10 < 7 else words(rng, 1) for k, w in enumerate(item))
    items = spark.createDataFrame([(1, " ".join(item), "forty two")], "item_id long, text string, answer string")
    rows = [(1, f"{loose} forty two"), (2, f"{loose} forty three"), (3, " ".join(item))] + [(i, words(rng, 100)) for i in range(10, 40)]
    got = {r.doc_id: r.answered for r in decontaminate.leaked_passages(documents(spark, rows), items, answer_col="answer").collect()}
    assert got == {1: True, 3: False}


def test_word_hashes_stay_small():
    own, most = WordHashes(), 0
    for n in range(0, 500_000, 10_000):
        own.of([b"word%d" % i for i in range(n, n + 10_000)])
        most = max(most, sys.getsizeof(own) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in own.items()))
    assert most < 16e6


def test_word_hashes_forget(monkeypatch):
    monkeypatch.setattr(WordHashes, "room", 3)
    own = WordHashes()
    assert own.of([b"a", b"b", b"c", b"d", b"a"]).tolist()[0] == own.of([b"a"]).tolist()[0] and len(own) <= 3


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"file://{tmp_path}/{name}")
        new = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert new.columns == docs.columns
            rows, before = {r.doc_id: r.text for r in new.collect()}, {r.doc_id: r.text for r in docs.collect()}
            assert set(rows) <= set(before)
            if name == "near_dedup":
                want = {c for _, _, c in brute_components(list(before.items()), 5)}
                assert set(rows) == want
            if name == "suffix_dedup":
                assert set(rows) == set(before) and {d for d in rows if rows[d] != before[d]} == set(brute_repeats(before.items(), 50))
            if name == "decontaminate":
                plain = lambda t: b" ".join(decontaminate.Words(t).at(0, 10**9))
                assert not any(plain(b.text) in plain(t) for b in benchmark for t in rows.values())
                assert all(any(plain(b.text) in plain(before[d]) for b in benchmark) for d in set(before) - set(rows))
            if name == "quality":
                bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
                labelled = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
                assert len((set(rows) & labelled) ^ (labelled - bad)) <= 0.1 * len(labelled)
            docs = new
        else:
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_decides_per_row(spark, tmp_path):
    """Rows that repeat an id, or have none, are kept or dropped by their own text."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))
    one, other, third, lone = text(), text(), text(), text()
    rows = [(1, one), (2, one), (2, other), (3, third), (3, third), (None, lone), (None, lone + " x"), (None, third), (4, None), (4, "")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, doc_row int")
    out = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got in [sorted([(1, one), (2, other), (3, third), (None, kept), (4, None), (4, "")], key=str) for kept in (lone, lone + " x")]
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(5, f"{one} {leak} {other}"), (5, other), (None, leak), (None, one)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SMALL).collect()), key=str) == sorted([(5, other), (None, one)], key=str)
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = known.unionByName(known.where("doc_id < 40"))
    kept = {r.doc_id: r["count"] for r in corpus_pipeline.quality(spark, docs, SMALL).groupBy("doc_id").count().collect()}
    assert 0.5 * known.count() < len(kept) < known.count() and all(n == 1 + (d < 40) for d, n in kept.items())


def test_cuts_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2), (2, None, 3, 4)], "doc_id long, text string, __id int, __mark int")
    assert sorted(map(tuple, suffixes.cut_repeats(docs).collect())) == [(1, "a b", 1, 2), (2, None, 3, 4)]
