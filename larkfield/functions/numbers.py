"""Score transforms and weighted sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Fixed values of the scoring model.
QUERY_ITEM_WEIGHTS = {"tfidf": 0.42, "bm25": 0.18, "category": 0.14, "topic_jaccard": 0.12,
                      "topic_contain": 0.06, "title_overlap": 0.05, "type_match": 0.03}
ITEM_ITEM_WEIGHTS = {"cosine": 0.52, "category": 0.20, "topic_jaccard": 0.13, "topic_contain": 0.08,
                     "type_match": 0.04, "title_overlap": 0.03}
FIELD_WEIGHTS = {"title": 0.38, "topics": 0.37, "full": 0.25}
CONFIDENCE_FLOOR, CONFIDENCE_START, CONFIDENCE_POWER = 0.9, 0.5, 0.7
RELEVANCE_GATE, ITEM_FLOOR, OFF_TOPIC_GATE = 0.48, 0.42, 0.55


def display_confidence(norm: Column) -> Column:
    """Shown share in [0.9, 1] of a score relative to the best one."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (norm - CONFIDENCE_START) / (1 - CONFIDENCE_START)))
    return CONFIDENCE_FLOOR + (1 - CONFIDENCE_FLOOR) * F.pow(t, F.lit(CONFIDENCE_POWER))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column, keys: Sequence[str]) -> Column:
    """Softmax inside each group of a bounded size, shifted by the group maximum."""
    w = Window.partitionBy(*keys)
    shifted = F.exp(x - F.max(x).over(w))
    return shifted / F.sum(shifted).over(w)


def weighted(weights: Mapping[str, float], cap: float = 1.0) -> Column:
    """Weighted sum of the named columns (null counts as 0), at most ``cap``."""
    total = None
    for name, w in weights.items():
        term = w * F.coalesce(F.col(name), F.lit(0.0))
        total = term if total is None else total + term
    return F.least(total, F.lit(cap))


def box_cox(x: Column, lam: float) -> Column:
    """Box-Cox transform with a given lambda."""
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def category_bonus(a: Column, b: Column, related: Sequence[tuple[str, str]], words_a: Column, words_b: Column) -> Column:
    """1 for equal categories, then .55 related, .35 two shared words, .15 one, else 0."""
    linked = F.lit(False)
    for x, y in related:
        linked = linked | ((a == x) & (b == y)) | ((a == y) & (b == x))
    shared = F.size(F.array_intersect(F.array_distinct(words_a), words_b))
    return (F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(linked, 0.55)
            .when(shared >= 2, 0.35).when(shared == 1, 0.15).otherwise(0.0))
