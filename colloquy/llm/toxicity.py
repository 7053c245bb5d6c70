"""Toxicity by a factorization machine over hashed terms.

A term is a distinct word of the text or one of its beginnings (inflected and compound insults share them).
The machine adds a weight per term and, through a short vector per term, one per pair of terms, so that
an insult may count more beside a group's name than alone. It is trained by one task on a bounded
sample of labelled rows; scoring runs over all texts in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Memory

#: Labelled rows that a model is fitted on, about; more are thinned out by a hash.
SAMPLE = 24_000
#: Hash space of terms, and the terms a model keeps: those most telling of the label.
BUCKETS, TERMS = 1 << 20, 8192
#: Length of a term's vector.
FACTORS = 8
#: Beginnings of longer words that are terms too.
BEGINNINGS = (4, 5)
#: Bytes of words and buckets that a worker remembers.
MEMORY = 32 << 20
_WORD = re.compile(r"\w+")


def _buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word: its own and those of its beginnings."""
    names = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


@lru_cache(maxsize=1)
def _terms() -> Memory:
    return Memory(_buckets, MEMORY, 250)


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's terms."""
    of = _terms()
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((b for w in words for b in of[w]), np.int32))


@dataclass
class Machine:
    """``bias``, and per kept term its bucket, weight and vector."""
    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def index(self) -> np.ndarray:
        """Row of each bucket; -1 for those not kept."""
        at = np.full(BUCKETS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at

    def score(self, rows: np.ndarray) -> float:
        """Probability of label 1 for a text with the kept terms ``rows``."""
        v = self.vectors[rows]
        z = self.bias + self.weights[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def telling(texts: list[np.ndarray], labels: np.ndarray, most: int = TERMS) -> np.ndarray:
    """Buckets in at least 4 texts whose share of label 1 differs from the overall one by over 2.5 standard errors."""
    both = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    owner = np.repeat(labels, [len(t) for t in texts])
    df, pos = np.bincount(both, minlength=BUCKETS), np.bincount(both, weights=owner, minlength=BUCKETS)
    share = labels.mean() if len(labels) else 0.0
    error = np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    z = np.where(df >= 4, np.abs(pos - df * share) / error, 0)
    some = np.flatnonzero(z > 2.5)
    return np.sort(some[np.argsort(-z[some], kind="stable")][:most])


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.03, seed: int = 7) -> Machine:
    """Fit by Adam on the logistic loss with weight decay. Without both labels the score is the share of label 1."""
    share = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if len(labels) else 1e-4
    bias = float(np.log(share / (1 - share)))
    empty = np.zeros(0, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Machine(bias, empty, np.zeros(0), np.zeros((0, FACTORS)))
    kept = telling(texts, labels)
    at = np.full(BUCKETS, -1, np.int32)
    at[kept] = np.arange(len(kept))
    rows = [(r := at[t])[r >= 0] for t in texts]
    rng = np.random.default_rng(seed)
    # Parameters in one matrix: column 0 the weight, the rest the vector; the last row holds the bias.
    theta = np.zeros((len(kept) + 1, FACTORS + 1))
    theta[:-1, 1:] = rng.normal(0, 0.05, (len(kept), FACTORS))
    theta[-1, 0] = bias
    m, s, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            sizes = np.array([len(rows[i]) for i in pick])
            flat = np.concatenate([rows[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes)
            own = theta[flat]
            sums = np.zeros((len(pick), FACTORS + 1))
            squares = np.zeros(len(pick))
            np.add.at(sums, owner, own)
            np.add.at(squares, owner, (own[:, 1:] ** 2).sum(axis=1))
            z = theta[-1, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            off = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[pick]) / len(pick)
            grad = np.zeros_like(theta)
            each = np.concatenate([np.ones((len(flat), 1)), sums[owner, 1:] - own[:, 1:]], axis=1) * off[owner, None]
            np.add.at(grad, flat, each)
            grad[-1, 0] = off.sum()
            touched = np.append(np.unique(flat), len(kept))
            g = grad[touched] + theta[touched] * np.array([1e-5] + [1e-3] * FACTORS)
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * g
            s[touched] = 0.999 * s[touched] + 0.001 * g * g
            theta[touched] -= rate * (m[touched] / (1 - 0.9 ** step)) / (np.sqrt(s[touched] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(float(theta[-1, 0]), kept, theta[:-1, 0].copy(), theta[:-1, 1:].copy())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from the labelled rows of ``docs(doc_id, text)`` outside the held-out fold.

    A document with several labels counts as toxic if one of them says so; null labels and ids are left out.
    The sample is drawn by a hash of the id, about ``sample`` rows of however many; its labels go to every task,
    its hashed terms to one.
    """
    own = (labels.select("doc_id", F.col("toxic").cast("double").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = own.count()
    share = min(1.0, sample / max(n, 1))
    drawn = own.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "terms", "y"])

    def learn(batches):
        texts, ys, ids = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += [np.asarray(t.values, np.int32) for t in batch.column(1)]
            ys += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(texts[i]), texts[i].tobytes()))      # the same machine however rows arrive
        made = fit([texts[i] for i in order], np.array([ys[i] for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array([made.bias]), pa.array([made.buckets.tolist()], pa.list_(pa.int32())), pa.array([made.weights.tolist()], pa.list_(pa.float64())),
                                          pa.array([made.vectors.ravel().tolist()], pa.list_(pa.float64()))], names=["bias", "buckets", "weights", "vectors"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")
    rows = texts.mapInArrow(hashed, "doc_id long, terms array<int>, y double").repartition(1).mapInArrow(learn, "bias double, buckets array<int>, weights array<double>, vectors array<double>")
    found = rows.first()
    if found is None:
        return fit([], np.zeros(0))
    return Machine(found["bias"], np.array(found["buckets"], np.int64), np.array(found["weights"]), np.array(found["vectors"]).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a column of scores of whole texts; null and empty texts score by the bias alone. A column of that name is replaced.

    Only the texts go through Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)      # bounded by the terms a model keeps

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        at = model.index()
        for batch in batches:
            out = []
            for value in batch:
                rows = at[terms(value.as_py())]
                out.append(model.score(rows[rows >= 0]))
            yield pa.array(out, pa.float64())

    return docs.withColumn(column, scored(F.col(f"`{text}`")))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; an empty table gives no rows."""
    machine = train(docs, labels, sample)
    scored = score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
