"""Operators on small frames with answers worked out by hand or by brute force."""

import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkfield.functions import stats
from larkfield.functions import text as tx
from larkfield.operators import catalog, cf, clean, dense, graph, judgments, learn, profile, quality, ranking, search, skills, star
from larkfield.operators import evaluation as ev
from larkfield.operators import query_text as qt
from larkfield.operators.feed import resolve_shares
from larkfield.sources import posts
from larkfield.sources import tables as tb
from larkfield.streaming import changes as ch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -------------------------------------------------------------------- ranking

def test_top_per_group_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id")
    plan = ranking.top_per_group(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("Exchange")


def test_group_positions_equal_plain_row_numbers(spark):
    data = [(random.Random(i).choice([1, 1, 1, 2]), i) for i in range(300)]
    df = spark.createDataFrame(data, "k int, v long")
    got = ranking.group_positions(df, ["k"], [F.col("v")], F.floor(F.col("v") / 7), "pos", "n")
    want, seen = [], {}
    for k, v in sorted(data, key=lambda x: x[1]):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, seen[k], sum(1 for a, _ in data if a == k)))
    assert rows(got.select("k", "v", "pos", "n")) == sorted(want)


def test_buckets_grow_with_rows_and_are_even(spark):
    skewed = spark.range(200000).select((F.col("id") * F.col("id") * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("v"))
    for rows_per_bucket, buckets in ((10 ** 9, 64), (1000, 256), (1, ranking.FINEST)):
        got = ranking.with_range_bucket(skewed, "v", rows_per_bucket).groupBy("_bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_bucket").collect()
        assert len(got) == buckets and max(r.n for r in got) < 1.5 * 200000 / buckets
        assert all(a.high < b.low for a, b in itertools.pairwise(got))


def test_running_counts_on_any_split(spark):
    values = [float(x) for x in (3, 1, -7, 22, 8, 0, 5, 100, float("inf"))]
    df = spark.createDataFrame([(k, v, i + 1) for k in "ab" for i, v in enumerate(values)], "k string, v double, n int")
    want = {(k, v): sum(j + 1 for j, x in enumerate(values) if x <= v) for k in "ab" for v in values}
    for rows_per_bucket in (1, 10 ** 6):
        out = ranking.running_counts(df, "v", ["n"], rows_per_bucket, ["k"]).collect()
        assert {(r.k, r.v): r.cum_n for r in out} == want and {r.all_n for r in out} == {45}
    assert ranking.running_counts(df.limit(0), "v", ["n"]).count() == 0


def test_exact_quantiles_with_a_hot_value(spark):
    values = [5.0] * 400 + [random.Random(i).gauss(0, 10) for i in range(301)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ranking.exact_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
    for got, p in zip(row, (0.05, 0.5, 0.95)):
        assert got == pytest.approx(float(np.quantile(values, p)))


def test_number_rows_is_consecutive(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as v").repartition(9)
    out = catalog.number_rows(df, [F.col("v")], "n")
    assert rows(out.select("v", "n")) == [(i, i + 1) for i in range(1000)]


# ----------------------------------------------------------------- star quirks

def test_fact_fans_out_by_payments_squared_and_line_grain_does_not(spark):
    import datetime as dt
    day = dt.date(2020, 1, 5)
    orders = spark.createDataFrame([(1, 9, "F", day)], "order_id long, customer_id long, order_status string, purchase_date date")
    items = spark.createDataFrame([(1, 1, 5, 7, 10.0, 1.0), (1, 2, 5, 7, 20.0, 2.0)],
                                  "order_id long, order_item_id int, product_id long, seller_id long, price double, freight_value double")
    pay = spark.createDataFrame([(1, i, "card", 1.0, 10.0) for i in (1, 2, 3)],
                                "order_id long, payment_sequential int, payment_type string, payment_installments double, payment_value double")
    rev = spark.createDataFrame([(100, 1), (101, 1)], "review_id long, order_id long")
    key = lambda name, v: spark.createDataFrame([(v,)], f"{name} long")
    dates = star.dim_date(orders, "purchase_date")
    args = (orders, items, pay, rev, key("product_id", 5), key("customer_id", 9), key("seller_id", 7), dates)
    assert star.fact_sales(*args, grain="reference").count() == 2 * 3 * 3 * 2
    line = star.fact_sales(*args, grain="line")
    assert line.count() == 2
    assert {r["payment_value"] for r in line.collect()} == {30.0}


def test_customer_dimension_replaces_place_with_geolocation(spark):
    c = spark.createDataFrame([(1, "a", 10), (2, "b", 99)], "customer_id long, customer_unique_id string, zip int")
    g = spark.createDataFrame([(10, "Ulm", "BW"), (10, "Alm", "AA")], "zip int, city string, state string")
    assert rows(star.dim_customer(c, g).select("customer_id", "city")) == [(1, "Alm"), (2, None)]


def test_quality_predicates(spark):
    df = spark.createDataFrame([(1, 5.0), (None, 1.0), (2, -1.0)], "k int, v double")
    r = quality.fact_check(df, ["k"], ["v"]).first()
    assert (r["null_keys"], r["negative_amounts"], r["passed"]) == (1, 1, False)
    assert quality.fact_check(df.na.drop().filter("v > 0"), ["k"], ["v"]).first()["passed"]
    assert not quality.key_check(df.union(df), "k").first()["passed"]


def test_fill_blanks(spark):
    df = spark.createDataFrame([("x",), (" ",), ("NaN",), (None,), ("n/a",)], "c string")
    assert [r[0] for r in clean.fill_blanks(df, {"c": "?"}, ["nan", "none", "n/a"]).collect()] == ["x", "?", "?", "?", "?"]


# ----------------------------------------------------------------------- text

def says_twice(tokens, longest=4):
    low = [t.lower() for t in tokens]
    return any(low[i:i + k] == low[i + k:i + 2 * k] for k in range(1, longest + 1) for i in range(len(low) - 2 * k + 1))


def is_part_of(short, whole):
    rest = iter(whole)
    return all(any(a == b for b in rest) for a in short)


def check_collapsed(raw, got):
    """No phrase is said twice in a row, words stay in order, and texts without repeats stay whole."""
    assert not says_twice(got.split()) and is_part_of(got.split(), raw.split())
    assert says_twice(raw.split()) or got.split() == raw.split()
    assert set(got.lower().split()) == set(raw.lower().split())


def test_collapse_repeats(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["to", "be", "Be", "or", "été"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["a b b b a b c b a c c a c b b a b b b b b b c b a a a b a a a c c c a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.collapse_repeats(F.col("t")).alias("c"))
    out = {r["t"]: r["c"] for r in df.collect()}
    for raw, got in out.items():
        check_collapsed(raw, got)
    assert out[texts[-2]] == "a b c b a c a"


def test_collapse_repeats_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", tx.collapse_repeats(F.col("text")).alias("c"))
    for r in docs.collect():
        check_collapsed(r["text"], r["c"])


@pytest.mark.parametrize("raw, want", [
    ("https://youtu.be/abcdefghijk?t=3", "abcdefghijk"), ("http://www.youtube.com/watch?x=1&v=abc-efg_ijk", "abc-efg_ijk"),
    ("m.youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("abcdefghijk", "abcdefghijk"), ("https://example.com/watch?v=abcdefghijk", None),
    ("https://youtu.be/short", None), (None, None)])
def test_video_id(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(tx.video_id(F.col("u"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("word word , next.One more", "Word, next. One more"), ("a ,b", "A, b"), ("", ""), ("end .", "End.")])
def test_clean_display(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(tx.clean_display(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("['a b', 'c']", "a b, c"), ('["x", "y"]', "x, y"), ("a|b;c/d", "a, b, c, d"), ("nan", ""), ("", ""), ("[1, 2]", "1, 2")])
def test_clean_topics(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.clean_topics(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("GREAT Product", "great product"), ("see http://a.b/c now", "see now"), ("<b>bold</b> move", "bold move"),
    ("well, done!", "well done"), ("fine \U0001F600", "fine"), ("", "")])
def test_clean_review(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.clean_review(F.col("t"))).first()[0] == want


def test_strip_accents_and_composed(spark):
    df = spark.createDataFrame([("Đà Nẵng",), ("éte",)], "t string")
    assert [r[0] for r in df.select(tx.strip_accents(F.col("t"))).collect()] == ["da nang", "ete"]
    assert {r[0] for r in catalog.composed(df, "t").collect()} == {"Đà Nẵng", "éte"}


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(tx.with_ngrams(F.col("t"))).collect()]
    assert got == [["a", "b", "c", "a_b", "b_c", "a_b_c"], ["a"], []]


def test_corrections_find_every_pair_in_reach(spark):
    rng = random.Random(8)
    letters = "abcd"
    known = sorted({"".join(rng.choice(letters) for _ in range(n)) for n in [*range(4, 24), 31, 32, 33, 47, 63, 64, 90, 130] * 14})
    rng.shuffle(known)
    asked = []
    for w in known[:200]:
        chars = list(w)
        # Up to the allowed share of letters and a little beyond; letters change, go or are put in.
        for _ in range(rng.randint(1, max(1, round(0.19 * len(w)) + 1))):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice([[rng.choice(letters)], [], [chars[at], rng.choice(letters)], ["\U0001d4b3"]])
        asked.append("".join(chars))
    asked += ["", "ab", "abcd" * 300]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {}
    for a in {x for x in asked if x not in known and len(x) >= 4}:
        close = [(round(1 - distance(a, k) / max(len(a), len(k)), 6), k) for k in known if abs(len(a) - len(k)) <= 0.17 * max(len(a), len(k))]
        close = [(-s, k) for s, k in close if s >= 0.84]
        if close:
            want[a] = min(close)[1]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {r["word"]: r["fixed"] for r in qt.corrections(frame(asked), frame(known)).collect()}
    assert got == want
    assert max(map(len, want)) > 100 and len(want) > 60
    assert qt.corrections(frame(["abcdef"]), frame(["x"]).limit(0)).count() == 0


def test_noise_is_repeatable_and_light(spark):
    df = spark.createDataFrame([("the quick brown fox jumps over the lazy dog " * 20,)], "t string")
    a, b = (df.repartition(n).select(qt.add_noise(F.col("t"), 7)).first()[0] for n in (1, 3))
    bare = "the quick brown fox jumps over the lazy dog " * 20
    assert a == b != bare and 0.9 * len(bare) < len(a) <= len(bare)


def test_follow_up_needs_a_short_message_without_entity(spark):
    conv = spark.createDataFrame([(1, 0, "user", "tell me about spark"), (1, 1, "assistant", "sure"), (1, 2, "user", "how long"),
                                  (1, 3, "user", "spark and joins")], "conv_id long, turn long, role string, text string")
    out = qt.follow_up_context(conv, "conv_id", "turn", "role", "text", F.contains("text", F.lit("spark")), r"\bstill\b")
    assert rows(out.select("turn", "resolved")) == [(0, "tell me about spark"), (2, "tell me about spark how long"), (3, "spark and joins")]


# ---------------------------------------------------------------- collaborative

def brute_similarity(pairs, k):
    users = {}
    for u, i in set(pairs):
        users.setdefault(u, set()).add(i)
    pop, shared = {}, {}
    for basket in users.values():
        for i in basket:
            pop[i] = pop.get(i, 0) + 1
        for i, j in itertools.permutations(basket, 2):
            shared[i, j] = shared.get((i, j), 0) + 1
    best = {}
    for (i, j), n in shared.items():
        best.setdefault(i, []).append((-round(n / math.sqrt(pop[i] * pop[j]), 9), j, n))
    return sorted((i, j, n) for i, found in best.items() for _, j, n in sorted(found)[:k])


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_item_similarity_is_exact_for_any_basket_limit(spark, limit):
    rng = random.Random(3)
    pairs = [(u, rng.randrange(40)) for u in range(12) for _ in range(rng.choice([2, 4, 30]))]
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    got = cf.item_similarity(df, 5, limit).select("item_i", "item_j", "shared")
    assert rows(got) == brute_similarity(pairs, 5)


def test_baskets_sent_to_blocks_grow_with_the_input(spark):
    """Twice the users and items make twice the blocks and twice the entries sent, not four times."""
    rng = random.Random(4)
    one = [(u, i) for u in range(40) for i in rng.sample(range(60), 6)]

    def sent(copies):
        known = spark.createDataFrame([(u + 1000 * c, i + 1000 * c) for c in range(copies) for u, i in one], "user_id long, item_id long")
        pop = known.groupBy("item_id").count().withColumnRenamed("count", "pop")
        out, many = cf.basket_blocks(known, pop, 1000, 120)
        assert many.isEmpty()
        return out.select("block").distinct().count(), out.selectExpr("sum(size(items))").first()[0]

    (blocks, few), (more, many) = sent(2), sent(4)
    assert more >= 1.8 * blocks and many <= 2.2 * few


def test_items_beyond_a_task_are_joined(spark):
    """Bounds on users or on basket entries decide the path, never the result."""
    rng = random.Random(6)
    pairs = [(u, i) for u in range(30) for i in rng.sample(range(25), 8)]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "user_id long, item_id long")
    got = [rows(cf.item_similarity(df, 4, heavy, entries).select("item_i", "item_j", "shared", "rank")) for heavy, entries in ((1000, 10**6), (8, 10**6), (1000, 70), (0, 1))]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 100


def test_recommendations_by_block_equal_sums(spark):
    """Blocks of any size, users beyond a block, a user without id, excluded items: always the sums over the history."""
    rng = random.Random(8)
    history = sorted({(u, rng.randrange(30)) for u in range(25) for _ in range(rng.choice([1, 5, 20]))})
    sim = {(i, j): rng.randrange(1, 9) / 8 for i in range(28) for j in rng.sample(range(30), 6) if i != j}
    out = {(u, 2) for u in range(5)}
    want = []
    for u in {u for u, _ in history}:
        mine, sums = {i for v, i in history if v == u}, {}
        for (i, j), x in sim.items():
            if i in mine:
                sums[j] = sums.get(j, 0) + x
        best = sorted((-x, j) for j, x in sums.items() if j not in mine and (u, j) not in out)[:4]
        want += [(u, j, -x, r) for r, (x, j) in enumerate(best, 1)]
    h = spark.createDataFrame(history, "user_id long, item_id int")
    s = spark.createDataFrame([(i, j, x) for (i, j), x in sim.items()], "item_i int, item_j int, sim double")
    x = spark.createDataFrame(sorted(out), "user_id long, item_id int")
    for entries in (1, 6, 1000):
        got = cf.recommend(h, s, 4, exclude=x, entries=entries)
        assert rows(got.select("user_id", "item_id", "score", "rank")) == sorted(want)
    none = cf.recommend(h.unionByName(spark.createDataFrame([(None, 1)], h.schema)), s, 4, exclude=x)
    assert rows(none.filter("user_id IS NOT NULL").select("user_id", "item_id", "score", "rank")) == sorted(want)
    assert none.filter("user_id IS NULL").count() == 4


def test_hold_out_one_does_not_depend_on_partitions(spark):
    df = spark.range(200).selectExpr("id % 20 as user_id", "id as item_id")
    a, b = (rows(cf.hold_out_one(df.repartition(n), 7).filter("held").select("user_id", "item_id")) for n in (1, 7))
    assert a == b and len(a) == 20


def test_popular_skips_seen(spark):
    pop = spark.createDataFrame([(1, 9), (2, 8), (3, 7)], "item_id long, pop long")
    seen = spark.createDataFrame([(5, 1)], "user_id long, item_id long")
    users = spark.createDataFrame([(5,), (6,)], "user_id long")
    assert rows(cf.popular(users, seen, pop, 2).select("user_id", "item_id")) == [(5, 2), (5, 3), (6, 1), (6, 2)]


# ------------------------------------------------------------------ evaluation

def test_metrics_by_hand(spark):
    ranking_ = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, item_id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 99, 1), (2, 5, 1)], "query_id long, item_id long, grade int")
    by = {r["query_id"]: r for r in ev.query_metrics(ranking_, qrels, (1, 3)).collect()}
    one = by[1]
    dcg = 3 / math.log2(3) + 1 / math.log2(4)
    ideal = 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert one["p_3"] == pytest.approx(2 / 3) and one["r_3"] == pytest.approx(2 / 3) and one["hit_1"] == 0
    assert one["ndcg_3"] == pytest.approx(dcg / ideal)
    assert one["map"] == pytest.approx((1 / 2 + 2 / 3) / 3) and one["mrr"] == 0.5
    assert by[2]["ndcg_3"] == 0 and by[2]["mrr"] == 0
    per_config = ev.query_metrics(ranking_.withColumn("config", F.lit("a")), qrels, (1,), ["config"])
    assert per_config.count() == 2


def test_agreement_cases(spark):
    def kappa(pairs):
        return ev.agreement(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()["kappa"]
    assert kappa([(0, 0), (1, 1)] * 5) == 1.0
    assert kappa([(0, 0), (0, 1), (1, 0), (1, 1)] * 3) == pytest.approx(0.0)
    assert kappa([(1, 1)] * 4) == 1.0


def test_policy_values_closed_form(spark):
    log = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.5, 0.7), (2, 0.0, 0.5, 0.25, 0.5, 0.3)],
                                "id long, reward double, behavior_prop double, target_prop double, q_logged double, v_target double")
    r = ev.policy_values(log).first()
    assert r["ips"] == 1.0 and r["snips"] == pytest.approx(2 / 2.5) and r["naive"] == 0.5
    assert r["dr"] == pytest.approx((0.7 + 2 * 0.5 + 0.3 + 0.5 * -0.5) / 2)
    assert r["ess"] == pytest.approx(2.5 ** 2 / 4.25)


def test_auc_averages_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert ev.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(0.875)


def test_t_distribution_values():
    # Two-sided 5 % points of common tables.
    got = stats.t_two_sided(pd.Series([12.7062, 2.2281, 1.9840]), pd.Series([1.0, 10.0, 100.0]))
    assert list(got) == pytest.approx([0.05, 0.05, 0.05], abs=1e-5)


def test_bootstrap_covers_the_mean_and_repeats(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, 0.0, 0.0, rng.gauss(0.3, 1)) for i in range(400)], "query_id long, a double, b double, diff double")
    a, b = (ev.paired_bootstrap(df.repartition(n), draws=200).first() for n in (1, 5))
    assert a["ci_low"] < a["mean_diff"] < a["ci_high"]
    assert a["ci_low"] == pytest.approx(b["ci_low"]) and a["p_value"] < 0.05


def test_bootstrap_draws_equal_weighting_row_by_row(spark):
    rng = random.Random(2)
    data = [(i, rng.random(), rng.random() if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "query_id long, a double, b double")
    ratios = {"x": (F.col("a"), F.col("b")), "y": (F.col("b"), F.lit(1.0))}
    keys = df.select("query_id", F.xxhash64("query_id", F.lit(5)).alias("k")).toPandas().set_index("query_id")["k"]
    w = ev.poisson_counts(np.array([keys[i] for i, _, _ in data]), 40)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.06
    a, b = np.array([x for _, x, _ in data]), np.array([x or 0.0 for _, _, x in data])
    for parts in (1, 7):
        got = ev.bootstrap_ratios(df.repartition(parts), "query_id", ratios, 40, 5).orderBy("draw").toPandas()
        assert got["x"][0] == pytest.approx(a.sum() / b.sum()) and got["y"][0] == pytest.approx(b.sum() / 3000)
        assert list(got["x"][1:]) == pytest.approx(list((w * a[:, None]).sum(0) / (w * b[:, None]).sum(0)))
        assert list(got["y"][1:]) == pytest.approx(list((w * b[:, None]).sum(0) / w.sum(0)))
    assert ev.bootstrap_ratios(df.limit(0), "query_id", ratios, 3, 5).count() == 0


def test_gini_and_coverage(spark):
    rec = spark.createDataFrame([(1,), (1,), (2,)], "item_id long")
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id long")
    r = ev.exposure(rec, items).first()
    assert r["coverage"] == 0.5 and r["gini"] == pytest.approx((1 * 1 + 3 * 2) / (4 * 3))


def test_random_unlisted_items_are_unlisted(spark):
    items = spark.range(30).selectExpr("id as item_id")
    listed = spark.range(25).selectExpr("1L as query_id", "id as item_id")
    needs = spark.createDataFrame([(1, 4), (2, 3)], "query_id long, need int")
    got = rows(judgments.random_unlisted(needs, listed, items, 9))
    assert len(got) == 7 and all(q == 2 or i >= 25 for q, i in got)


def test_graded_pairs_meet_every_lower_grade(spark):
    data = [(1, i, 2 if i < 3 else 1 if i < 10 else 0, [float(i)]) for i in range(40)]
    data += [(2, 1, 1, [1.0]), (2, 2, 0, [2.0]), (3, 1, 2, [1.0]), (4, 1, None, [0.0]), (4, 2, 1, [0.0])]
    df = spark.createDataFrame(data, "query_id long, item_id long, grade int, f array<double>")
    got = learn.graded_pairs(df.repartition(5)).collect()
    counts = {}
    for r in got:
        assert r.grade > r.lower and r.item_id != r.other and r.g == [float(r.other)]
        counts[r.query_id, r.grade, r.lower] = counts.get((r.query_id, r.grade, r.lower), 0) + 1
    assert counts == {(1, 2, 1): 12, (1, 2, 0): 12, (1, 1, 0): 28, (2, 1, 0): 1}
    assert len({(r.query_id, r.item_id, r.other) for r in got}) == len(got)
    # The 28 places of grade 0 are spread over all its 30 rows but two.
    assert len({r.other for r in got if (r.query_id, r.grade, r.lower) == (1, 1, 0)}) == 28
    assert sorted(map(tuple, ((r.item_id, r.other) for r in learn.graded_pairs(df.coalesce(1)).collect()))) == sorted(
        (r.item_id, r.other) for r in got)


# --------------------------------------------------------------------- search

def test_nearest_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "VECTORS_PER_BLOCK", 17)
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", 9)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "item_id long, vector array<double>")
    q = v.withColumnRenamed("item_id", "query_id")
    s = np.round(m @ m.T, 9)
    want = sorted((i, j) for i in range(60) for j in sorted((x for x in range(60) if x != i), key=lambda x: (-s[i, x], x))[:5])
    assert rows(dense.nearest(v, q, 5, True).select("query_id", "item_id")) == want
    assert dense.above(v, q, 0.5, True).count() == int(((s >= 0.5).sum()) - 60)
    listed = {(i, j) for i in range(60) for j in range(60) if (i == 7 and j < 58) or (i % 3 == 0 and j % 2 == 0)} - {(7, 7)}
    barred = spark.createDataFrame(sorted(listed) * 2, "query_id long, item_id long")
    want = sorted((i, j) for i in range(60) for j in sorted((x for x in range(60) if x != i and (i, x) not in listed),
                                                            key=lambda x: (-s[i, x], x))[:5])
    assert rows(dense.nearest(v, q, 5, True, barred).select("query_id", "item_id")) == want


def test_best_places_equal_a_full_sort(monkeypatch):
    monkeypatch.setattr(dense, "HEAD", 8)
    rng = np.random.default_rng(9)
    for k in (1, 3, 10):
        s = np.round(rng.normal(size=(40, 60)), 1)
        s[3], s[4, 2:], s[5, ::2], s[6, :5] = 0.5, -np.inf, np.nan, np.inf
        rows_, columns = dense.best_places(s, k)
        t = np.where(np.isnan(s), -np.inf, s)
        want = np.argsort(-t, axis=1, kind="stable")[:, :k]
        assert (rows_ == np.repeat(np.arange(40), k)).all() and (columns.reshape(40, k) == want).all()


class VectorTables:
    """Tables of a plan: vectors whose ids and labels repeat or are missing."""

    def __init__(self, spark):
        rng = np.random.default_rng(11)
        x = rng.normal(size=(70, 4))
        rows_ = [(i, x[i].tolist(), int(rng.integers(3)) if i % 9 else None) for i in range(70)]
        rows_ += [*rows_[3:25], (4, x[4].tolist(), 2), (-5, x[1].tolist(), 1)]
        self.spark, self.embeddings = spark, spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int").persist()


@pytest.fixture(scope="module")
def labelled(spark):
    return VectorTables(spark)


def test_labels_stand_for_their_pairs(spark, labelled, monkeypatch):
    from larkfield.plans import answers, evaluation as plans
    monkeypatch.setattr(ev, "RUN", 7)
    rel = plans.same_label(labelled)
    near = plans.neighbours10(labelled).persist()
    assert rows(plans.label_grades(labelled).select("query_id", "grade", "n")) == rows(ev.grade_counts(rel))
    assert rows(plans.judged_of(labelled, near).select("query_id", "item_id", "grade")) == rows(
        rel.join(near.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").select("query_id", "item_id", "grade"))
    assert rows(plans.metrics10(labelled)) == rows(ev.query_metrics(near, rel))
    got = plans.pooled_ranking(labelled)
    assert rows(got) == rows(ev.pooled_ranking(near, rel).select("query_id", "item_id", "rank"))
    picked = ranking.top_per_group(rel, ["query_id"], [judgments.seeded("query_id", "item_id", seed=5), F.col("item_id")], 6)
    assert rows(answers.picked_of_label(labelled, 6, 5)) == rows(picked.select("query_id", "item_id", "grade"))
    unlisted = dense.nearest(plans.vectors(labelled), answers.query_vectors(labelled), 5, skip_self=True, listed=rel)
    assert rows(answers.best_unlisted(labelled, 5).select("query_id", "item_id", "rank")) == rows(unlisted.select("query_id", "item_id", "rank"))


def test_pairs_of_a_label_are_arrays_not_rows(spark):
    many = spark.range(400).selectExpr("id as item_id", "0 as label")
    arrays = ev.label_pairs(many, many.withColumnRenamed("item_id", "query_id"))
    assert arrays.count() == 400 and arrays.selectExpr("sum(size(ids))").first()[0] == 160_000


def test_a_block_of_queries_is_scored_in_slices(spark, monkeypatch):
    """No step of a task sees more scores than a slice of queries times a block of vectors."""
    seen, plain = [], dense.best_places
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(dense, "best_places", lambda s, k: (seen.append(s.shape), plain(s, k))[1])
    x = np.random.default_rng(1).normal(size=(50, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, vector array<double>")
    run = {}
    cogroup = type(v.groupBy("item_id").cogroup(v.groupBy("item_id")))
    monkeypatch.setattr(cogroup, "applyInPandas", lambda self, f, schema: (run.update(f=f), v.sparkSession.createDataFrame([], schema))[1])
    dense.nearest(v, v.withColumnRenamed("item_id", "query_id"), 3)
    block = pd.DataFrame({"item_id": range(50), "item_vector": list(x)})
    found = run["f"](block, block.rename(columns={"item_id": "query_id", "item_vector": "query_vector"}))
    assert len(found) == 150 and max(n for n, _ in seen) == 7


def test_pairs_of_one_label_are_passed_over(spark):
    x = np.random.default_rng(7).normal(size=(30, 4))
    labels = [None if i == 5 else [i % 3, 9] if i == 8 else [i % 3] for i in range(30)]
    labels[9] = [9]
    v = spark.createDataFrame([(i, r.tolist(), own) for i, (r, own) in enumerate(zip(x, labels))], "item_id long, vector array<double>, labels array<int>")
    got = rows(dense.nearest(v, v.withColumnRenamed("item_id", "query_id"), 4, True).select("query_id", "item_id"))
    s = np.round(x @ x.T, 9)
    free = lambda i, j: i != j and not set(labels[i] or ()) & set(labels[j] or ())
    assert got == sorted((i, j) for i in range(30) for j in sorted((j for j in range(30) if free(i, j)), key=lambda j: (-s[i, j], j))[:4])


def test_mmr_is_greedy_and_keeps_the_pool(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(rng.random(12), 6)
    pool = spark.createDataFrame([(1, i, float(score[i]), m[i].tolist()) for i in range(12)],
                                 "query_id long, item_id long, score double, vector array<double>")
    chosen = []
    while len(chosen) < 5:
        def value(i):
            return score[i] if not chosen else 0.7 * score[i] - 0.3 * max(float(m[i] @ m[j]) for j in chosen)
        chosen.append(max((i for i in range(12) if i not in chosen), key=value))
    rest = sorted((i for i in range(12) if i not in chosen), key=lambda i: -score[i])
    got = [r["item_id"] for r in search.mmr(pool, 5).orderBy("rank").collect()]
    assert got == chosen + rest


def test_rank_fusion_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(1, 8, 1)], "query_id long, item_id long, rank int")
    one, two = (rows(search.reciprocal_rank_fusion(x)) for x in (a.union(b), b.union(a)))
    assert one == two and dict((i, s) for _, i, s in one)[8] == pytest.approx(1 / 62 + 1 / 61)


def test_detect_category_falls_back_to_names(spark):
    lex = search.Lexicon(phrases=(("deep nets", "AI"), ("nets", "Fishing")), categories=("Web Design", "AI"))
    df = spark.createDataFrame([("learn deep nets",), ("nets at sea",), ("modern web design",), ("cooking",)], "q string")
    assert [r[0] for r in df.select(search.detect_category(F.col("q"), lex)).collect()] == ["AI", "Fishing", "Web Design", None]


# --------------------------------------------------------------------- tables

def test_upsert_rejects_or_resolves_repeated_keys_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "id int, v string")
    with pytest.raises(ValueError):
        tb.upsert(old, new, ["id"])
    once = tb.upsert(old, new, ["id"], "latest", [F.desc("v")])
    assert rows(once) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(tb.upsert(once, new, ["id"], "latest", [F.desc("v")])) == rows(once)



def test_load_if_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tb.load_if_empty(spark, spark.range(2), path)
    assert not tb.load_if_empty(spark, spark.range(5), path)
    assert tb.load_if_empty(spark, spark.range(5), path, force=True)
    assert spark.read.parquet(path).count() == 5


def test_read_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'id,txt\r\n1,"a, ""b"""\r\n2,"two\r\nlines"\r\n')
    got = tb.read_csv(spark, str(tmp_path / "x.csv"), "id int, txt string")
    assert [r["id"] for r in got.collect()] == [1, 2] and got.first()["txt"] == 'a, "b"'


def test_jdbc_options_split_the_read():
    o = tb.jdbc_options("jdbc:x", "t", "id", 1, 100, 8)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "1", "100", "8")
    assert "partitionColumn" not in tb.jdbc_options("jdbc:x", "t")


def test_snapshots_read_back_by_version_and_time(spark, tmp_path):
    store = tb.Snapshots(spark, str(tmp_path / "s"))
    store.commit(spark.range(3))
    store.delete(F.col("id") == 0)
    store.add_column("note", "string")
    assert store.read(1).count() == 3 and store.read().columns == ["id", "note"]
    first = store.history().filter("version = 1").first()["committed"]
    assert store.read(as_of=first).count() == 3


def test_managed_table_and_reference(spark):
    ref = tb.TableRef("gold", "sales", "gold_fact")
    assert ref.table == "fact" and ref.path("/r") == "/r/gold/sales/fact"


def test_flatten_posts_shapes(spark):
    posts_ = [('{"slug":"a","title":"T","contents":"body","tags":[{"name":"x"},{"slug":"y"}],"user":{"data":{"name":"N"}}}'),
              ('{"slug":"a","title":"again"}'), ('{"url":"http://u","title":"U","excerpt":"e","tags":{"data":["p","q"]}}'), ('{"title":"lost"}')]
    df = spark.createDataFrame(list(enumerate(posts_)), "seq int, j string")
    got = rows(posts.flatten_posts(df, "j", "seq", "https://b/", "none"))
    assert got == [(0, "T", "body", "x", "x, y", "N", "https://b/a"), (2, "U", "e", "p", "p, q", "", "http://u")]


# -------------------------------------------------------------------- streams

def test_widening_rules():
    assert ch.widen("bigint", "double") == "double" and ch.widen("bigint", "string") == "string"
    assert ch.merge_types({"a": "bigint"}, {"b": "string", "a": "double"}) == {"a": "double", "b": "string"}


def test_typed_tables_skip_deletes_widen_and_replay(spark, tmp_path):
    def batch(values, start):
        data = [("db.t", "t", "k", v, start + i) for i, v in enumerate(values)]
        return spark.createDataFrame(data, "topic string, table_name string, key string, value string, position long")
    tables = ch.TypedTables(spark, str(tmp_path / "typed"))
    tables.write_batch(batch(['{"payload":{"after":{"id":1,"n":5}}}', '{"payload":{"after":null}}'], 0), 0)
    later = batch(['{"payload":{"after":{"id":2,"n":1.5,"extra":"e"}}}'], 10)
    tables.write_batch(later, 1)
    tables.write_batch(later, 1)
    assert rows(tables.read("t").select("id", "n", "extra")) == [(1, 5.0, None), (2, 1.5, "e")]


# ----------------------------------------------------------------- graph, skills

def test_friend_states(spark):
    edges = spark.createDataFrame([(1, 2, "accepted"), (3, 1, "pending")], "a long, b long, status string")
    got = {(r["node"], r["neighbour"]): r["state"] for r in graph.friendship_state(edges, "a", "b", "status").collect()}
    assert got == {(1, 2): "friends", (2, 1): "friends", (3, 1): "pending_sent", (1, 3): "pending_received"}


def test_share_chains_end_at_the_first_post(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, None)], "id long, up long")
    assert rows(resolve_shares(df, "id", "up").select("id", "origin")) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)]


def test_next_skills_in_first_seen_order(spark):
    known = spark.createDataFrame([(1, "py", 1), (1, "sql", 2)], "user_id long, skill string, place int")
    edges = spark.createDataFrame([("py", "sql", 1), ("py", "git", 2), ("sql", "etl", 1)], "src string, dst string, ord int")
    out = skills.next_skills(known, edges)
    assert [r["skill"] for r in out.orderBy("rank").collect()] == ["git", "etl"]


def test_enrichment_runs_once_per_new_text(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("",)], "t string")
    cache = spark.createDataFrame([("b", "known")], "text string, value string")
    out, fresh = catalog.enrich_missing(df, "t", cache, lambda s: s.str.upper())
    assert rows(out) == [("", ""), ("a", "A"), ("a", "A"), ("b", "known")] and fresh.count() == 1


def test_profile_skewness_is_bias_corrected(spark):
    values = [1.0, 2.0, 3.0, 10.0, 11.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(profile.sample_skewness(F.col("v"))).first()[0] == pytest.approx(float(pd.Series(values).skew()))


def test_share_circles_are_an_error(spark):
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, up long")
    with pytest.raises(ValueError):
        resolve_shares(circle, "id", "up")


def test_typed_search_takes_heads_of_the_type(spark):
    items = spark.createDataFrame([(i, f"t{i}", "Music", [], "d", "book" if i < 3 else "course") for i in range(1, 5)],
                                  "item_id long, title string, category string, topics array<string>, description string, type string")
    asked = spark.createDataFrame([(1, "melodies")], "query_id long, query string")
    lex = search.Lexicon(phrases=(("melodies", "Music"),), categories=("Music",))
    got = search.lexical_search(items, asked, lex, 2, "course")
    assert sorted(r.item_id for r in got.collect()) == [3, 4]


def test_inferred_types_keep_every_name(spark):
    rows_ = spark.createDataFrame([('{"id":1,"zip-code":"x","a b":2,"n":{"c":3}}',), ('{"id":2.5,"ok":true}',)], "j string")
    assert ch.inferred_types(rows_, "j") == {"id": "double", "zip-code": "string", "a b": "bigint", "n": "string", "ok": "boolean"}


def test_stratified_split_is_exact_per_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = {(r.label, r.part): r["count"] for r in learn.stratified_split(df, "id").groupBy("label", "part").count().collect()}
    assert got == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}


def test_vectors_above_each_other_equal_brute_force(spark, monkeypatch):
    """Blocks that meet once, tiles smaller than blocks, repeated and missing ids, missing vectors, rounding inside the tasks."""
    monkeypatch.setattr(dense, "VECTORS_PER_BLOCK", 23)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(90, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = [*range(80), 3, 3, 7, None, *range(100, 106)]
    data = [(i, x.tolist()) for i, x in zip(ids, m)] + [(200, None)]
    v = spark.createDataFrame(data, "item_id long, vector array<double>")
    want = sorted((ids[i] or 0, ids[j] or 0, float((m[i] * m[j]).sum())) for i in range(90) for j in range(90)
                  if (ids[i] is None or ids[i] != ids[j]) and (m[i] * m[j]).sum() >= 0.3)
    for tile in ((128, 2048), (5, 7)):
        monkeypatch.setattr(dense, "TILE", tile)
        got = sorted((r.query_id or 0, r.item_id or 0, r.score) for r in dense.above_each_other(v, 0.3).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
        exact = dense.above_each_other(v, 0.3).withColumn("score", F.round("score", 2))
        assert rows(dense.above_each_other(v, 0.3, digits=2).na.fill(-1)) == rows(exact.na.fill(-1))


def test_rounding_in_tasks_equals_sparks(spark):
    x = [0.125, -0.125, 0.375, 2.675, 1.005, 0.2123455, 0.2123465, 1e-9, -1e-9, 123456789.1234565, 1e300, float("inf"), 0.5, 1.5, -2.5]
    x += np.random.default_rng(1).normal(size=300).tolist()
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for digits in (0, 2, 6):
        want = [r[0] for r in df.coalesce(1).select(F.round("x", digits)).collect()]
        assert dense.rounded(np.array(x), digits).tolist() == want
    assert np.isnan(dense.rounded(np.array([float("nan")]), 6)).all()
