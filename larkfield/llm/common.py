"""Helpers shared by the training-data operators: scratch tables, word hashing, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.session import ensure_checkpoint_dir, work_folder

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


class Scratch:
    """Intermediate tables in the shared folder, by name; ``drop`` deletes those no later step reads."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, lasting: bool = False):
        self.spark = spark
        self.folders: dict[str, str] = {}
        if not lasting:
            Scratch._open.append(self)

    @classmethod
    def drop_finished(cls) -> None:
        """Delete the tables of all operators called before; only once their results were written."""
        while cls._open:
            scratch = cls._open.pop()
            scratch.drop(*scratch.folders)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: lost executors lose no work, and joins know real sizes."""
        self.drop(name)
        self.folders[name] = work_folder(self.spark, name)
        df.write.parquet(self.folders[name])
        return self.spark.read.schema(df.schema).parquet(self.folders[name])

    def drop(self, *names: str) -> None:
        for name in names:
            folder = self.folders.pop(name, None)
            if folder:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, as a URI or an absolute path."""
    ensure_checkpoint_dir(spark)
    return work_folder(spark, name)


class WordHashes(dict):
    """Word bytes to 64-bit hash; forgets everything when ``room`` words are held, about 15 MB."""

    room = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def give_back() -> None:
    """Return to the system what earlier tasks of this worker left unused in Arrow's pool."""
    pa.default_memory_pool().release_unused()


def ascii_words(text: bytes | str | None) -> list[bytes]:
    """Words between ASCII blanks, with A-Z in lower case; other letters stay as they are."""
    if not text:
        return []
    raw = text.encode("utf-8") if isinstance(text, str) else text
    return raw.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; none when there are fewer words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = mixed(out * M1 + hashes[i:i + size] + np.uint64(i + 1))
    return out


def components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the smallest node reachable.

    Alternates two steps until nothing moves: each node hands its larger neighbours, then its
    smaller ones, to the smallest it knows. Every step is a grouped minimum and a join, so a node with
    very many neighbours is summed before the shuffle and its rows can be split.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = scratch.keep(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), f"{name}0")
    state, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        step += 1
        large = scratch.keep(large, f"{name}{step % 2}large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before = f"{name}{step - 1}"
        new = scratch.keep(new, f"{name}{step}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step % 2}large", before)
        if seen == state:
            break
        state, now = seen, new
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
