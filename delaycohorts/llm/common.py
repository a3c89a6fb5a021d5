"""What the training-data operators share: tables, packed rows, word ids and component labels."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaycohorts.session import materialize

# The six ASCII white-space characters that part words (fixed by the contract).
WHITE = " \t\n\x0b\x0c\r"
WORD_CACHE = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text, F.lit(""))




class WordIds(dict):
    """64-bit ids of words (bytes); forgets everything when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n-word window, in order; a shorter non-empty text is one window."""
    if len(ids) == 0:
        return ids
    n = min(n, len(ids))
    out = np.full(len(ids) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out + ids[k : len(ids) - n + 1 + k] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (a, b) with the smallest node it can reach.

    Alternating large-star and small-star steps; each is a partial minimum per node and a join
    that Spark can split when a hub is hot. Every step is written to the shared folder, so the
    lineage stays short. Returns (node, component); empty edges give an empty table.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = None
    for _ in range(rounds):
        around = both(current)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        current = materialize(small.where("a <> b").distinct())
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == stamp:
            break
        stamp = seen
    else:
        raise RuntimeError("components did not settle")
    leaves = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
