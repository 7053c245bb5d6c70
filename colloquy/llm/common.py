"""What the training-data operators share: tables, shared storage, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans.store import materialise

#: Bytes of Arrow rows handed to Python at once are bounded by rows; texts may be long.
BATCH_ROWS = 512
#: A lookup side is broadcast only up to this many rows; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


class Memory(dict):
    """What ``make`` gives for a word, remembered by a worker up to about ``most`` bytes (``entry`` for each besides the word).

    In two generations: when the newer is full it replaces the older, and what is still asked for moves on.
    """

    def __init__(self, make: Callable, most: int, entry: int = 200, longest: int = 64):
        super().__init__()
        self.make, self.room, self.entry, self.longest = make, most // 2, entry, longest
        self.old: dict = {}
        self.size = 0

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            self.size += self.entry + len(word)
            if self.size > self.room:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (materialised, narrow) with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node of ``edges(a, b)``.

    Alternating star contraction. In each round every node's larger neighbours are moved to its
    smallest one, then the smaller ones likewise, until nothing moves; rounds grow with the
    logarithm of the longest chain. Each round is written to shared storage. Self-links and
    repeated or reversed links are allowed; links with a null end are ignored. A node's links
    are never gathered: hubs meet their minimum by a join that can be split.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    now = materialise(edges)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # Larger neighbours of every node move to its smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        # Smaller neighbours and the node itself move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = (near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
                 .where("a != b").distinct())
        now = materialise(small)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)``: the smallest node that links ``a[i], b[i]`` reach, for each node of them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low
