"""Set measures on arrays without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 when either side is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(wanted: Column, given: Column) -> Column:
    """Share of ``wanted`` found in ``given``; 0 when nothing is wanted."""
    return F.when(F.size(wanted) > 0,
                  F.size(F.array_intersect(wanted, given)).cast("double") / F.size(wanted)).otherwise(0.0)


def contained_words(wanted: Column, text: Column) -> Column:
    """Share of ``wanted`` words that occur as a substring of ``text``."""
    hits = F.size(F.filter(wanted, lambda w: F.contains(text, w))).cast("double")
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(0.0)
