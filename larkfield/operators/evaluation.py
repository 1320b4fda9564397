"""Ranking metrics, beyond-accuracy measures, tests of significance, off-policy values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.operators.catalog import number_rows
from larkfield.operators.ranking import running_counts

CUTS = (1, 3, 5, 10, 100)


# ---------------------------------------------------------------- per query

def grade_counts(qrels: DataFrame) -> DataFrame:
    """``query_id, grade, n``: relevant items per query and grade."""
    return qrels.filter(F.col("grade") > 0).groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))


def ideal_gain(grades: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Best reachable DCG per query and cut, and the number of relevant items, out of ``grade_counts``.

    A query with very many relevant items costs one row per grade; the sum of discounts is read from its place range.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    placed = grades.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))

    def discounts(k: int) -> Column:
        """Sum of discounts of the places before+1 .. before+n, cut at k."""
        last = F.least(F.col("_before") + F.col("n"), F.lit(k))
        places = F.when(last > F.col("_before"), F.sequence(F.col("_before") + 1, last)).otherwise(
            F.array().cast("array<bigint>"))
        return F.aggregate(places, F.lit(0.0), lambda acc, p: acc + 1 / F.log2(p + 1))

    return placed.groupBy("query_id").agg(
        F.sum("n").alias("n_relevant"),
        *[F.sum((F.pow(F.lit(2.0), "grade") - 1) * discounts(k)).alias(f"_ideal_{k}") for k in cuts])


def query_metrics(rankings: DataFrame, qrels: DataFrame, cuts: Sequence[int] = CUTS,
                  keys: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """P, R, NDCG and hit rate at each cut, average precision and reciprocal rank.

    ``rankings(*keys, query_id, item_id, rank)``, ``qrels(query_id, item_id,
    grade)``. Every judged query appears for every key; a missing ranking scores 0.
    With ``counts`` (as from :func:`grade_counts`), ``qrels`` need only hold the pairs of the rankings.
    """
    judged = qrels.filter(F.col("grade") > 0).select("query_id", "item_id", "grade")
    ideal = ideal_gain(grade_counts(qrels) if counts is None else counts, cuts)
    rels = rankings.join(judged, ["query_id", "item_id"]).select(*keys, "query_id", "rank", "grade")
    w = Window.partitionBy(*keys, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = rels.withColumn("_hits", F.count(F.lit(1)).over(w))
    rank, gain = F.col("rank"), (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)
    aggs = [F.sum(F.col("_hits") / rank).alias("_ap"), (1 / F.min("rank")).alias("mrr")]
    for k in cuts:
        aggs.append(F.count_if(rank <= k).alias(f"_hit_{k}"))
        aggs.append(F.sum(F.when(rank <= k, gain)).alias(f"_dcg_{k}"))
    per = hits.groupBy(*keys, "query_id").agg(*aggs)
    if keys:
        # Few configurations meet all judged queries, so none is left out of the mean.
        grid = ideal.withColumn("_k", F.explode(_distinct_array(rankings, keys))).select(*ideal.columns, "_k.*")
    else:
        grid = ideal
    out = grid.join(per, [*keys, "query_id"], "left")
    n_rel = F.col("n_relevant")
    columns = [*keys, "query_id", "n_relevant"]
    for k in cuts:
        got = F.coalesce(f"_hit_{k}", F.lit(0))
        columns += [(got / k).alias(f"p_{k}"), (got / n_rel).alias(f"r_{k}"),
                    F.coalesce(F.col(f"_dcg_{k}") / F.col(f"_ideal_{k}"), F.lit(0.0)).alias(f"ndcg_{k}"),
                    (got > 0).cast("double").alias(f"hit_{k}")]
    columns += [F.coalesce(F.col("_ap") / n_rel, F.lit(0.0)).alias("map"), F.coalesce("mrr", F.lit(0.0)).alias("mrr")]
    return out.select(*columns)


def _distinct_array(df: DataFrame, keys: Sequence[str]) -> Column:
    """The distinct key values as one array; configurations are few by nature."""
    return df.select(*keys).distinct().agg(F.collect_list(F.struct(*keys)).alias("v")).scalar()


def mean_metrics(per_query: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro mean of every metric."""
    skip = {*keys, "query_id", "n_relevant"}
    names = [c for c in per_query.columns if c not in skip]
    return per_query.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in names])


def pooled_ranking(ranking: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranking of labelled items only; labelled items that were not found come last."""
    joined = labels.join(ranking.select("query_id", "item_id", F.col("rank").alias("_r")), ["query_id", "item_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("_r").asc_nulls_last(), "item_id")
    return joined.withColumn("rank", F.row_number().over(w)).drop("_r")


#: Salts that part the queries of one label, and items of a label per array.
SALTS, RUN = 64, 10_000


def _label_runs(items: DataFrame) -> DataFrame:
    """``label, before, ids``: ascending ids of a label in arrays of at most ``RUN``, and how many come before them."""
    known = items.filter(F.col("label").isNotNull() & F.col("item_id").isNotNull()).select("label", "item_id")
    placed = number_rows(known, [F.col("label"), F.col("item_id")], "_place")
    firsts = placed.groupBy("label").agg(F.min("_place").alias("_first"))
    before = F.floor((F.col("_place") - F.col("_first")) / RUN) * RUN
    return placed.join(firsts, "label").groupBy("label", before.alias("before")).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))


def label_pairs(items: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked(query_id, label, ...)`` with the ids that ``items(item_id, label)`` has of their label, as arrays ``ids``.

    The rows of a label are parted by salt, so no task gets a label whole.
    """
    salt = F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")
    runs = _label_runs(items).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Sizes known before the salts are dealt would have all copies of the arrays broadcast by the driver.
    return asked.withColumn("_salt", salt).join(runs.hint("merge"), ["label", "_salt"]).drop("_salt", "label")


def pooled_by_label(ranking: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`pooled_ranking` where items of one label are labelled for each other, without shuffling or sorting the pairs.

    An item that was not found comes after those found, at its place among the label's ids less those passed
    over before it. Ids that ask more than once are ranked by :func:`pooled_ranking`.
    """
    asked = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").alias("query_id"), "label")
    twice = asked.groupBy("query_id").count().filter("count > 1").select("query_id")
    once = asked.join(twice, "query_id", "left_anti")
    found = ranking.select("query_id", "item_id", "rank").join(once, "query_id").join(items.select("item_id", "label"), ["item_id", "label"])
    found = found.filter("query_id <> item_id")
    w = Window.partitionBy("query_id").orderBy("rank", "item_id")
    head = found.select("query_id", "item_id", F.row_number().over(w).alias("rank"))
    many = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_many"))
    # An id that comes more than once stands in the label's ids as often, however often it was found.
    places = found.select("query_id", "item_id", "label").distinct().join(items.select("item_id", "label"), ["item_id", "label"])
    lists = once.join(places.groupBy("query_id").agg(F.collect_list("item_id").alias("_found")).join(many, "query_id"), "query_id", "left")
    rest = label_pairs(items, lists).select("query_id", "_found", "_many", "before", F.posexplode("ids").alias("_pos", "item_id"))
    rest = rest.filter((F.col("query_id") != F.col("item_id")) & ~F.coalesce(F.array_contains("_found", F.col("item_id")), F.lit(False)))
    smaller = F.when(F.col("_found").isNull(), 0).otherwise(F.size(F.filter("_found", lambda x: x < F.col("item_id"))))
    passed = smaller + F.when(F.col("query_id") < F.col("item_id"), 1).otherwise(0)
    tail = rest.select("query_id", "item_id", (F.coalesce("_many", F.lit(0)) + F.col("before") + F.col("_pos") + 1 - passed).alias("rank"))
    again = label_pairs(items, asked.join(twice, "query_id", "left_semi")).select("query_id", F.explode("ids").alias("item_id"))
    last = pooled_ranking(ranking, again.filter("query_id <> item_id"))
    return head.unionByName(tail).unionByName(last.select("query_id", "item_id", "rank"))


# ---------------------------------------------------------- beyond accuracy

def exposure(recommended: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coverage of the catalog and Gini index of how often items are shown (zeros count)."""
    shown = recommended.groupBy("item_id").agg(F.count(F.lit(1)).alias("times"))
    counts = catalog.select("item_id").join(shown, "item_id", "left").select(F.coalesce("times", F.lit(0)).alias("times"))
    # Equal counts take consecutive places; their place sum is closed-form.
    groups = counts.groupBy("times").agg(F.count(F.lit(1)).alias("n"))
    cum = running_counts(groups, "times", ["n"])
    first, last, n = F.col("cum_n") - F.col("n") + 1, F.col("cum_n"), F.col("all_n")
    place_sum = (first + last) * F.col("n") / 2
    total = F.sum(F.col("times") * F.col("n"))
    return cum.agg(
        (F.sum(F.when(F.col("times") > 0, F.col("n")).otherwise(0)) / F.max("all_n")).alias("coverage"),
        (F.sum(F.col("times") * (2 * place_sum - (n + 1) * F.col("n"))) / (F.max("all_n") * total)).alias("gini"))


def list_diversity(recommended: DataFrame, vectors: DataFrame) -> DataFrame:
    """1 - mean pair cosine per list of two or more, without building pairs.

    Sum of all pair products = |sum of vectors|^2 - sum of |vector|^2.
    """
    cells = (recommended.join(vectors, "item_id")
             .select("query_id", F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x")))
    dims = cells.groupBy("query_id", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"),
                                                F.count(F.lit(1)).alias("n"))
    return dims.groupBy("query_id").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("cross")).filter(
        "n >= 2").select("query_id", "n", (1 - F.col("cross") / (F.col("n") * (F.col("n") - 1))).alias("ild"))


def novelty(recommended: DataFrame, popularity: DataFrame) -> DataFrame:
    """Mean -log2((pop + 1) / (sum of pop + items)) over all recommended items."""
    base = popularity.agg((F.sum("pop") + F.count(F.lit(1))).alias("v")).scalar()
    with_base = recommended.join(popularity, "item_id").withColumn("_base", base)
    return with_base.agg(F.avg(-F.log2((F.col("pop") + 1) / F.col("_base"))).alias("novelty"))


def serendipity(recommended: DataFrame, relevant: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean share per list of items that are relevant and not expected."""
    key = ["query_id", "item_id"]
    good = recommended.join(relevant.select(*key), key, "left_semi").join(expected.select(*key), key, "left_anti")
    marked = recommended.join(good.select(*key).distinct().withColumn("_g", F.lit(1)), key, "left")
    per = marked.groupBy("query_id").agg(F.avg(F.coalesce("_g", F.lit(0))).alias("s"))
    return per.agg(F.avg("s").alias("serendipity"))


# ------------------------------------------------------------- significance

def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Per-query differences of two configurations on the same queries."""
    left = a.select("query_id", F.col(value).alias("a"))
    return left.join(b.select("query_id", F.col(value).alias("b")), "query_id").withColumn("diff", F.col("a") - F.col("b"))


#: Rows weighted at once: bounds a task's memory to this many rows times the draws.
ROWS_AT_ONCE = 512


def poisson_limits(most: int = 18) -> np.ndarray:
    """Cumulative Poisson(1) chances; a uniform number's place among them is its count."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers scrambled by xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_counts(keys: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) counts (rows x draws) from hashed keys, the same on any partitioning."""
    steps = np.arange(1, draws + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    bits = mixed(keys.astype("int64").view("uint64")[:, None] + steps[None, :])
    return np.searchsorted(poisson_limits(), (bits >> np.uint64(11)) * 2.0 ** -53, side="right").astype("float64")


def bootstrap_ratios(rows: DataFrame, key: str, ratios: Mapping[str, tuple[Column, Column]], draws: int, seed: int) -> DataFrame:
    """Bootstrap values of ratios ``sum(w * numerator) / sum(w * denominator)``: one row per draw, a column per name.

    Draw 0 is the sample itself. All ratios and draws come from one scan: a task
    weights its rows by Poisson counts, adds them up in arrays and emits one row
    per draw, whatever its number of rows. A null part adds nothing.
    """
    parts = [F.coalesce(c.cast("double"), F.lit(0.0)) for pair in ratios.values() for c in pair]
    width = len(parts)
    flat = rows.select(F.xxhash64(key, F.lit(seed)).alias("k"), F.array(*parts).alias("x"))

    def add_up(batches):
        sums = np.zeros((draws + 1, width))
        seen = False
        for part in batches:
            for at in range(0, len(part), ROWS_AT_ONCE):
                seen = True
                x = np.stack(part["x"].to_numpy()[at:at + ROWS_AT_ONCE])
                sums[0] += x.sum(axis=0)
                sums[1:] += poisson_counts(part["k"].to_numpy()[at:at + ROWS_AT_ONCE], draws).T @ x
        if seen:
            yield pd.DataFrame({"draw": np.arange(draws + 1), **{f"s{i}": sums[:, i] for i in range(width)}})

    schema = "draw int, " + ", ".join(f"s{i} double" for i in range(width))
    total = flat.mapInPandas(add_up, schema).groupBy("draw").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    return total.select("draw", *[F.try_divide(f"s{2 * i}", f"s{2 * i + 1}").alias(name) for i, name in enumerate(ratios)])


def intervals(drawn: DataFrame, names: Sequence[str], level: float = 0.95) -> DataFrame:
    """Value of the sample, percentile interval and spread per name, from a bounded number of draws."""
    side = (1 - level) / 2
    long = drawn.select("draw", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select(
        "draw", "x.*").withColumn("drawn", F.when(F.col("draw") > 0, F.col("value")))
    return long.groupBy("name").agg(
        F.max(F.when(F.col("draw") == 0, F.col("value"))).alias("value"), F.percentile("drawn", side).alias("ci_low"),
        F.percentile("drawn", 1 - side).alias("ci_high"), F.stddev_samp("drawn").alias("se"),
        F.avg((F.col("drawn") <= 0).cast("double")).alias("share_below"), F.avg((F.col("drawn") >= 0).cast("double")).alias("share_above"))


def paired_bootstrap(pairs: DataFrame, draws: int = 1000, seed: int = 13, level: float = 0.95) -> DataFrame:
    """Mean difference, interval and two-sided p of per-query differences, in one scan."""
    some = F.col("diff").isNotNull().cast("double")
    out = intervals(bootstrap_ratios(pairs, "query_id", {"mean": (F.col("diff"), some)}, draws, seed), ["mean"], level)
    p = 2 * F.when(F.col("value") >= 0, F.col("share_below")).otherwise(F.col("share_above"))
    return out.select(F.col("value").alias("mean_diff"), "ci_low", "ci_high", F.least(p, F.lit(1.0)).alias("p_value"))


def t_statistic(pairs: DataFrame) -> DataFrame:
    """Paired t statistic with its degrees of freedom."""
    mean, sd, n = F.avg("diff"), F.stddev_samp("diff"), F.count(F.lit(1))
    t = F.when(sd > 0, mean / (sd / F.sqrt(n))).when(mean == 0, 0.0).otherwise(F.lit(float("inf")))
    return pairs.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), mean.alias("mean_diff"), n.alias("n"),
                     F.when(n < 2, 0.0).otherwise(t).alias("t_stat"))


def compare(pairs: DataFrame, alpha: float = 0.05, draws: int = 1000) -> DataFrame:
    """t-test and bootstrap of two configurations in one row."""
    from larkfield.functions.stats import t_two_sided

    p = F.pandas_udf(t_two_sided, "double")
    t = t_statistic(pairs).withColumn("p_ttest", p("t_stat", (F.col("n") - 1).cast("double")))
    boot = paired_bootstrap(pairs, draws, level=1 - alpha).select(
        F.struct("ci_low", "ci_high", F.col("p_value").alias("p_bootstrap")).alias("v")).scalar()
    return (t.withColumn("_b", boot).select(*t.columns, "_b.*")
            .withColumn("significant", F.col("p_ttest") < alpha))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa, raw agreement and row count of two label columns."""
    cells = labels.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    shares = cells.withColumns({"_t": total, "_ra": F.sum("n").over(Window.partitionBy("_a")),
                                "_rb": F.sum("n").over(Window.partitionBy("_b"))})
    # Expected agreement needs the row total of the label and its column total.
    rows = cells.groupBy(F.col("_a").alias("label")).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(F.col("_b").alias("label")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("v")).scalar()
    out = shares.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)) / F.max("_t"))
                     .alias("agreement")).withColumn("_pe", chance / (F.col("n") * F.col("n")))
    return out.select("n", "agreement", F.when(F.col("_pe") >= 1, 1.0).otherwise(
        (F.col("agreement") - F.col("_pe")) / (1 - F.col("_pe"))).alias("kappa"))


def binary_confusion(labels: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """True and false positives and negatives."""
    p, a = predicted.cast("boolean"), actual.cast("boolean")
    return labels.agg(F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"),
                      F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))


# --------------------------------------------------------------- thresholds

def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with averaged ranks for ties.

    Scores are counted per value first and ranked in two levels.
    """
    values = scored.groupBy(F.col(score).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    cum = running_counts(values, "_v", ["n"])
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2
    out = cum.agg(F.sum(mean_rank * F.col("pos")).alias("_r"), F.sum("pos").alias("n_pos"), F.sum("n").alias("_n"))
    neg = F.col("_n") - F.col("n_pos")
    auc = (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg)
    return out.select("n_pos", neg.alias("n_neg"), F.when((F.col("n_pos") > 0) & (neg > 0), auc).alias("auc"))


def average_ranks(scored: DataFrame, key: str, score: str) -> DataFrame:
    """Rank of every row by score, ties averaged."""
    values = scored.groupBy(F.col(score).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    cum = running_counts(values, "_v", ["n"])
    ranks = cum.select("_v", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))
    return scored.withColumn("_v", F.col(score).cast("double")).join(ranks, "_v").select(key, score, "rank")


def threshold_sweep(scored: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, from one aggregate pass."""
    y, s = F.col(label) == 1, F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(y & (s >= t)).alias(f"tp{i}"), F.count_if(~y & (s >= t)).alias(f"fp{i}"),
                 F.count_if(y & (s < t)).alias(f"fn{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                              F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    out = scored.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    tp = F.col("tp")
    p = F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp"))).otherwise(0.0)
    r = F.when(tp + F.col("fn") > 0, tp / (tp + F.col("fn"))).otherwise(0.0)
    return out.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def reliability(scored: DataFrame, label: str, score: Column, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal score bin of [0, 1]."""
    slot = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                                                 F.avg(F.col(label).cast("double")).alias("observed"))


def class_report(scored: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall and F1 per class, plus the confusion counts by row."""
    cells = scored.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"),
                                                             F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    out = rows.join(cols, "label", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    p = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    return out.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


# --------------------------------------------------------------- off-policy

def importance(behaviour: str, target: str, clip: float | None = None) -> Column:
    """Target over logged probability, cut at ``clip`` if given."""
    w = F.col(target) / F.greatest(F.col(behaviour), F.lit(1e-12))
    return w if clip is None else F.least(w, F.lit(clip))


def policy_values(log: DataFrame, clip: float | None = None) -> DataFrame:
    """Naive, IPS, self-normalised and doubly robust values, and the effective sample size.

    ``log(reward, behavior_prop, target_prop, q_logged, v_target)``.
    """
    w, full, r = importance("behavior_prop", "target_prop", clip), importance("behavior_prop", "target_prop"), F.col("reward")
    return log.agg(
        F.avg(r).alias("naive"), F.avg(w * r).alias("ips"), (F.sum(w * r) / F.sum(w)).alias("snips"),
        F.avg(F.col("v_target") + w * (r - F.col("q_logged"))).alias("dr"),
        (F.sum(full) * F.sum(full) / F.sum(full * full)).alias("ess"))


def policy_intervals(log: DataFrame, key: str, draws: int = 500, seed: int = 17, clip: float | None = None) -> DataFrame:
    """Each off-policy value of the log with its bootstrap interval; one scan for all estimators."""
    w, r = importance("behavior_prop", "target_prop", clip), F.col("reward")
    ratios = {"ips": (w * r, F.lit(1.0)), "snips": (w * r, w), "dr": (F.col("v_target") + w * (r - F.col("q_logged")), F.lit(1.0))}
    drawn = bootstrap_ratios(log, key, ratios, draws, seed)
    return intervals(drawn, list(ratios)).select(F.col("name").alias("estimator"), "value", "ci_low", "ci_high", "se")
