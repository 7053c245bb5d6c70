"""Nearest neighbours through a permutation index.

A vector is represented by its nearest pivots in order. Every shard posts its vectors in one inverted file
per pivot, with the pivot's place in the vector's order. For a query the postings of its own nearest pivots
are added up to footrule distances, the candidates that rank best are compared by exact cosine, and
shards widen their share of candidates until an audit against brute force passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.vectors import shards_for, valid
from colloquy.plans.store import materialise

#: Pivots (a bounded sample that the index is fitted on), and how many of the nearest a vector is posted under.
PIVOTS, PREFIX = 128, 16
#: Share of a shard compared exactly at first; doubled until the audit passes.
SHARE = 0.1
#: Queries of a block that are audited, and the recall they must show in each shard.
AUDITED, RECALL = 32, 0.98
#: Queries in a block.
BLOCK = 4096


def normal(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))


def order(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Index:
    """Pivot inverted files of one shard."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray):
        self.vectors, self.pivots = vectors, pivots
        own = order(vectors, pivots)
        self.prefix = own.shape[1]
        flat, member, place = own.ravel(), np.repeat(np.arange(len(own)), self.prefix), np.tile(np.arange(self.prefix), len(own))
        at = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[at], np.arange(len(pivots) + 1))
        self.files = [(member[at[a:b]], place[at[a:b]]) for a, b in zip(ends[:-1], ends[1:])]

    def footrule(self, places: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector to a query's order; a pivot that one of them lacks counts as the place after the last."""
        gained = np.zeros(len(self.vectors), np.int64)
        for mine, pivot in enumerate(places.tolist()):
            member, place = self.files[pivot]
            # Against a missing pivot's cost on both sides.
            gained[member] += (self.prefix - mine) + (self.prefix - place) - np.abs(place - mine)
        return self.prefix * (self.prefix + 1) - gained

    def search(self, queries: np.ndarray, orders: np.ndarray, share: float, k: int, own: np.ndarray) -> list[np.ndarray]:
        """For each query the ``k`` best candidates among the ``share`` of least footrule distance; ``own`` is the row a query is itself (-1: none)."""
        n, out = len(self.vectors), []
        budget = min(n, max(int(n * share), 8 * k) + 1)
        for query, places, me in zip(queries, orders, own):
            near = np.arange(n) if budget == n else np.argpartition(self.footrule(places), budget - 1)[:budget]
            near = near[near != me]
            out.append(best(near, self.vectors[near] @ query, k))
        return out


def best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest score and all that tie with the last up to rounding (the exact comparison follows)."""
    if len(rows) > k:
        least = np.partition(scores, -k)[-k]
        rows = rows[scores >= least - 1e-12]
    return rows


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision of the original vectors."""
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", embedding: str = "embedding", share: float = SHARE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found to every row whose key is divisible by ``every``.

    Candidates are all rows but the query's own; ties go to the smaller key. Vectors that are null, zero, or
    have null or non-finite components take no part, nor do rows without a key; vectors of other lengths than the most
    common are compared among their own length only. Repeated rows are candidates of each other only under other keys.
    Each shard gives its few best, so what is shuffled grows with shards times queries.
    """
    rows = valid(vectors, key, embedding).where("vec_id is not null").withColumn("dim", F.size("v"))
    rows = materialise(rows)
    n = rows.count()
    shards = shards_for(n)
    # Pivots: the vectors of each length that come first by a hash.
    drawn = rows.select("dim", "v", F.xxhash64("vec_id", F.lit("pivot")).alias("h"))
    lengths = [r["dim"] for r in drawn.select("dim").distinct().collect()]
    pivots = {d: np.array([r["v"] for r in drawn.where(F.col("dim") == d).orderBy("h", "v").limit(PIVOTS).collect()]) for d in lengths}       # bounded
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-n // (every * BLOCK)))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("int")
    index = rows.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def matrix(part: pa.Table) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("v").chunks]).reshape(part.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            original, asking = matrix(left), matrix(right)
            ids, mine = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            unit, wanted = normal(original), normal(asking)
            chosen = normal(shared.value[original.shape[1]])
            made = Index(unit, chosen)
            orders = order(wanted, chosen)
            # Rows of the query's own key, if this shard has it (the first of repeated ones; the others are dropped below).
            sorter = np.argsort(ids, kind="stable")
            at = np.minimum(np.searchsorted(ids, mine, sorter=sorter), len(ids) - 1)
            own = np.where(ids[sorter[at]] == mine, sorter[at], -1)
            audit = np.linspace(0, len(wanted) - 1, min(AUDITED, len(wanted))).astype(int)
            truth = [best((r := np.arange(len(unit)))[r != own[q]], (unit @ wanted[q])[r != own[q]], k) for q in audit]
            wide = share
            while True:
                got = made.search(wanted[audit], orders[audit], wide, k, own[audit])
                recall = np.mean([len(np.intersect1d(g, t)) / max(1, len(t)) for g, t in zip(got, truth)])
                if recall >= RECALL or wide >= 1:
                    break
                wide *= 2
            for q, rows_ in enumerate(made.search(wanted, orders, wide, k, own)):
                rows_ = rows_[ids[rows_] != mine[q]]
                scores = [cosine(original[r], asking[q]) for r in rows_]
                first = np.lexsort((ids[rows_], -np.array(scores)))[:k] if len(rows_) else []
                found["query_id"] += [mine[q]] * len(first)
                found["vec_id"] += ids[rows_][first].tolist() if len(rows_) else []
                found["score"] += [scores[i] for i in first]
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    keys = ("dim", "shard", "block")
    near = (index.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "vec_id", "v").groupBy(*keys))
            .applyInArrow(run, "query_id long, vec_id long, score double")).distinct()
    ranked = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))     # k a shard
    return ranked.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
