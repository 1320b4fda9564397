"""Terms counted in Arrow batches and sparse scores in blocks, against expressions and brute force."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.operators import answers as an
from larkfield.operators import search
from larkfield.operators import text_index as ti


def test_counts_in_batches_are_those_of_the_expressions(spark):
    texts = [(1, "Über the río, the Río the río"), (2, ""), (3, None), (4, "one"), (5, "a b"), (5, "a b a"), (None, "x y z x y")]
    df = spark.createDataFrame(texts, "k int, t string")
    for terms, every, grams in (
            (tx.words(F.col("t")), tx.with_ngrams(tx.words(F.col("t"))), ti.word_grams(3)),
            (tx.words(tx.strip_accents(F.col("t"))), tx.char_grams(F.col("t")), ti.char_grams(2, 4))):
        got = ti.doc_terms(df, "k", terms, grams=grams).collect()
        want = ti.term_rows(ti.counted(df, ["k"], every), "k").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def _vectors(rng, prefix, n, terms):
    rows = [(f, f"t{t}", rng.random() + 0.1) for _ in range(n) for f in "ab" for t in rng.sample(range(terms), 4)]
    return [(i // 8 + prefix, *row) for i, row in enumerate(rows)]


def test_scores_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ti, "WEIGHTS_PER_BLOCK", 300)
    monkeypatch.setattr(ti, "QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(ti, "DOCS_AT_ONCE", 16)
    rng = random.Random(5)
    docs, asked = _vectors(rng, 0, 150, 30), _vectors(rng, 1000, 20, 40)
    asked += [(1000, *row[1:]) for row in asked[:8]] + [(None, "a", "t1", 1.0)]  # rows that come twice, a query without an id
    raw = spark.createDataFrame(docs + [(None, "a", "t1", 1.0)], "item_id long, field string, term string, raw double")
    q = spark.createDataFrame(asked, "query_id long, field string, term string, qw double")
    norm, want = defaultdict(float), defaultdict(float)
    for i, f, _, w in docs:
        norm[i, f] += w * w
    for i, f, t, w in docs:
        for j, g, u, v in asked:
            if (f, t) == (g, u):
                want[j, i] += w / math.sqrt(norm[i, f]) * v
    found = ti.match_weights(raw, "item_id", q, "query_id", ["field"])
    got = {(r.query_id, r.item_id): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    for most, least in ((3, 0.0), (None, 1.0)):
        some = {(r.query_id, r.item_id): r.score for r in ti.match_weights(raw, "item_id", q, "query_id", ["field"], most=most, least=least).collect()}
        assert all(abs(some[k] - want[k]) < 1e-12 for k in some)
        if most is None:
            assert some.keys() == {k for k, s in want.items() if s >= least}
            continue
        assert len(some) < len(want)
        for j in {j for j, _ in want}:
            best = lambda scores: sorted((-round(s, 9), i) for (k, i), s in scores.items() if k == j)[:most]  # noqa: E731, B023
            assert best(some) == best(want)


def test_one_task_holds_no_table_of_pairs(spark):
    """The sums of a query and a document are not kept in a hash table that grows with the table."""
    raw = spark.createDataFrame([(1, "a", 1.0)], "item_id long, term string, raw double")
    q = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, qw double")
    plan = ti.match_weights(raw, "item_id", q, "query_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def _token_lists(spark, rng, joined=False):
    """Rows ``item_id, t, n, u``: tokens with times, and plain tokens; ids come twice, lists are empty or missing."""
    words = [f"w{i}" for i in range(40)]
    some = lambda n: [words[min(39, int(rng.expovariate(0.15)))] for _ in range(n)]
    rows = [(i // 2 if i < 6 else i, some(rng.randrange(0, 25)), some(rng.randrange(0, 9))) for i in range(120)]
    rows += [(900, [], None), (901, None, ["w1"])] + [(902, ["w0_w1", "w2", "w0", "w1_", "_"], ["w0_w1", "w0"])] * joined
    df = spark.createDataFrame(rows, "item_id long, t array<string>, u array<string>")
    pairs = [ti.repeated(F.col("t"), 3), ti.repeated(F.coalesce("u", F.array().cast("array<string>")), 2)]
    lists = df.select("item_id", F.concat(*[t for t, _ in pairs]).alias("t"), F.concat(*[n for _, n in pairs]).alias("n"), "u")
    return lists, [("a", "t", "n"), ("b", "u", None)]


def test_vocabulary_of_frequent_parts_is_that_of_all_grams(spark, monkeypatch):
    for joined, features, at_once in ((False, 60, 400_000), (True, 60, 400_000), (False, 15, 400_000), (False, 3000, 400_000), (False, 30, 35), (True, 25, 0)):
        monkeypatch.setattr(ti, "TERMS_AT_ONCE", at_once)
        monkeypatch.setattr(ti, "ROWS_NUMBERED", 50)
        lists, fields = _token_lists(spark, random.Random(features), joined)
        terms = ti.gram_rows(lists, "item_id", fields, ti.word_grams(3))
        total = ti.row_total(lists)
        want = ti.field_vocabulary(terms, ["a", "b"], total, max_df=0.6, max_features=features).collect()
        got = ti.frequent_vocabulary(lists, fields, 3, total, 0.6, features).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_terms_no_query_asks_for_leave_a_document_as_one_entry(spark):
    lists, fields = _token_lists(spark, random.Random(4), joined=True)
    vocab = ti.frequent_vocabulary(lists, fields, 3, ti.row_total(lists), 0.9, 80)
    asked = vocab.filter("term LIKE '%w1%'").select("field", "term")
    placed, places = ti.placed_weights(lists, "item_id", fields, ti.word_grams(3), vocab, asked, words=3)
    terms = ti.gram_rows(lists, "item_id", fields, ti.word_grams(3))
    want = ti.raw_weights(terms, "item_id", vocab, fields=["field"])
    shown = places.join(asked, ["field", "term"], "left_semi")
    got = placed.filter("_place >= 0").join(shown.select("term", "_place"), "_place").select("item_id", "term", F.round("raw", 9)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want.join(asked, ["field", "term"], "left_semi").select("item_id", "term", F.round("raw", 9)).collect())))
    assert placed.filter("_place < 0").count() <= 2 * lists.count()
    length = lambda df: {(r[0], r[1]): r[2] for r in df.groupBy("item_id", "f").agg(F.round(F.sum(F.col("raw") * F.col("raw")), 6)).collect()}
    assert length(placed.withColumnRenamed("_field", "f")) == length(want.withColumn("f", F.when(F.col("field") == "a", 0).otherwise(1)))


def test_bm25_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{min(30, int(rng.expovariate(0.2)))}" for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(80)] + [(100, "w0_w1 w2 w0 w1"), (101, ""), (5, "w1 w2")]
    asked = [(1, "w0 w1 w2"), (2, "w3 w0_w1"), (3, "zzz"), (4, ""), (2, "w3 w4")]
    grams = lambda t: [g for k in (1, 2, 3) for g in map("_".join, zip(*(t.split()[j:] for j in range(k))))]
    counts = [(i, grams(t)) for i, t in docs]
    df = {g: sum(g in c for _, c in counts) for _, c in counts for g in c}
    mean = sum(len(c) for _, c in counts) / len(counts)
    want = defaultdict(float)
    for q, t in asked:
        for g in set(grams(t)):
            for i, c in counts:
                if tf := c.count(g):
                    want[q, i] += math.log(1 + (len(docs) - df[g] + 0.5) / (df[g] + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len(c) / mean))
    d, q = spark.createDataFrame(docs, "item_id long, t string"), spark.createDataFrame(asked, "query_id long, t string")
    for at_once in (400_000, 0):
        monkeypatch.setattr(ti, "TERMS_AT_ONCE", at_once)
        found = ti.bm25(d, "item_id", F.filter(F.split("t", " "), lambda w: w != ""), q, "query_id", F.filter(F.split("t", " "), lambda w: w != ""))
        got = {(r.query_id, r.item_id): r.bm25 for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_vocabularies_sent_or_joined_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{min(60, int(rng.expovariate(0.1)))}ab" for _ in range(n))
    docs = spark.createDataFrame([(i // 2 if i < 4 else i, t := text(6), t.split(), rng.choice("xy"), rng.choice("pq"), text(20)) for i in range(60)],
                                 "item_id long, title string, topics array<string>, category string, type string, description string")
    asked = spark.createDataFrame([(i, text(5)) for i in range(6)], "query_id long, query string")
    seeds = asked.select("query_id", (F.col("query_id") * 7).alias("seed_id"), "query")
    lex = search.Lexicon(max_df=0.9, max_features=150)
    found = []
    for at_once in (400_000, 0):
        monkeypatch.setattr(ti, "TERMS_AT_ONCE", at_once)
        index = search.char_index(docs)
        assert index.sent == (at_once > 0)
        tables = [search.tfidf_scores(docs, asked, lex), search.char_scores(docs, asked, index=index), search.full_weights(docs, lex),
                  an.similar_items(docs, seeds, lex, 8, exclude=seeds.select("query_id", (F.col("seed_id") + 1).alias("item_id")), pool=12)]
        found.append([sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in tables])
    assert found[0] == found[1] and all(found[0])


def test_long_lists_are_cut_over_many_documents(spark):
    raw = spark.createDataFrame([(i, "a", 1.0 + i) for i in range(400)] + [(i, "b", 1.0) for i in range(400)], "item_id long, term string, raw double")
    q = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, qw double")
    found = ti.match_weights(raw, "item_id", q, "query_id", most=100).collect()
    assert sorted(r.item_id for r in found) == list(range(300, 400))
