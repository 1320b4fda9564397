"""Encoder hook: texts to unit vectors by any batch encoder, with the prefixes its model expects."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preset:
    """What a model wants to read before a passage and before a query."""

    passage: str = ""
    query: str = ""


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[Sequence[str]], np.ndarray], prefix: str = "") -> DataFrame:
    """``key, vector`` with vectors of length one; a vector of zeros stays as it is.

    ``encoder`` takes a batch of texts and returns a row of numbers for each. Null texts count as empty.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                found = np.asarray(encoder(list(part["_text"])), dtype="float64")
                length = np.sqrt((found ** 2).sum(axis=1, keepdims=True))
                yield pd.DataFrame({key: part[key], "vector": list(found / np.where(length > 0, length, 1))})

    told = df.select(key, F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    return told.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, vector array<double>")
