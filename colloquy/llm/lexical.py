"""Ranked lexical search by deduplicated bags.

Of a document only what the items ask for matters: its counts of item terms and its length class m. Documents that
agree in both score alike for every item, so they form a class (met by a hash, verified on the counts themselves) that is
scored once. Each task keeps the best of its classes per item; classes are expanded to their members by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from colloquy.plans.store import materialise

#: Results of an item.
TOP = 10
#: Items are searched in blocks of about so many (item, term) pairs; each block is one pass over the documents.
BLOCK_TERMS = 1 << 18
#: Bytes that are no part of a term become blanks, A-Z becomes a-z; bytes of characters past ASCII stay as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, repeats included."""
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, term)`` once each. Rows that share an id are one item; an item without terms has no row."""
    def run(batches):
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array([t.decode() for f in found for t in f], pa.string())], names=["item_id", "term"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"item_id {kind}, term string").distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms array<int>, counts array<int>)`` of each document with a term; numbers of known terms ascend."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)      # bounded by BLOCK_TERMS

    def run(batches):
        number = shared.value.get
        for batch in batches:
            kept, sizes, flat, lists = [], [], [], []
            for i, value in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms(value)
                if words:
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    own = sorted(held.items())
                    kept.append(i)
                    sizes.append(len(words))
                    lists.append(len(own))
                    flat += own
            both = np.array(flat, np.int32).reshape(-1, 2)
            ends = pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                                              *(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(both[:, k]))) for k in (0, 1))], names=names)

    names = ["doc_id", "n", "terms", "counts"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def classes(bagged: DataFrame, texts: int, total: int, best: int = TOP) -> DataFrame:
    """``(m, terms, counts, ids)``: a row per class of equal counts and m, with its ``best`` smallest ids (nulls last).

    Rows meet by a hash and are compared on their counts. Tasks keep ``best`` ids of a class before anything is shuffled.
    """
    keyed = (bagged.where("size(terms) > 0").withColumn("m", F.expr(f"10L + ((90L * n * {texts}L) div {max(total, 1)}L)"))
             .withColumn("h", F.xxhash64("m", "terms", "counts")))
    same = Window.partitionBy("h", "m", "terms", "counts")
    few = keyed.withColumn("place", F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= best)
    return (few.groupBy("h", "m", "terms", "counts").agg(F.collect_list(F.struct("doc_id")).alias("held"))
            .select("m", "terms", "counts", F.col("held.doc_id").alias("ids")))


def _highest(found: list[tuple], best: int) -> list[tuple]:
    """The ``best`` of ``(score, doc_id)``: high scores first, then small ids, null ids last."""
    return sorted(found, key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:best]


def _score(grouped: DataFrame, weights: np.ndarray, members: list[np.ndarray], n_items: int, best: int) -> DataFrame:
    """``(item, score, doc_id)``: of each task's classes, at most ``best`` members an item, the highest first.

    ``members[term]`` are the items with a term. A class comes with its ``best`` smallest ids, of which no more can be needed.
    """
    own = grouped.schema["ids"].dataType.elementType
    shared, ids_type = grouped.sparkSession.sparkContext.broadcast((weights, members)), to_arrow_type(own)

    def run(batches):
        weight, asks = shared.value
        held: list[list[tuple]] = [[] for _ in range(n_items)]
        least = np.zeros(n_items, np.int64)       # the score that a class has to reach
        for batch in batches:
            ids, m = batch.column(0), batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy()
            term, tf = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            offsets = offsets - offsets[0]
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(offsets))))
            for i in range(len(batch)):
                lo, hi = offsets[i], offsets[i + 1]
                score = np.zeros(n_items, np.int64)
                for t, v in zip(term[lo:hi].tolist(), value[lo:hi].tolist()):
                    score[asks[t]] += v
                for item in np.flatnonzero((score >= least) & (score > 0)).tolist():
                    held[item] += [(int(score[item]), doc) for doc in ids[i].as_py()]
                    if len(held[item]) > 8 * best:
                        held[item] = _highest(held[item], best)
                        least[item] = held[item][-1][0]
        out = [(item, s, doc) for item, rows in enumerate(held) for s, doc in _highest(rows, best)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()),
                                          pa.array([r[2] for r in out], ids_type)], names=["item", "score", "doc_id"])

    return grouped.select("ids", "m", "terms", "counts").mapInArrow(run, f"item int, score long, doc_id {own.simpleString()}")


def _search(docs: DataFrame, pairs: list, best: int, key: str, text: str, item_kind: str) -> DataFrame:
    """Results of one block of items, given as its ``(item_id, term)``."""
    spark = docs.sparkSession
    named = sorted({r["item_id"] for r in pairs}, key=lambda x: (x is None, 0 if x is None else x))
    place, number = {item: i for i, item in enumerate(named)}, {t: i for i, t in enumerate(sorted({r["term"].encode() for r in pairs}))}
    asked: list[list[int]] = [[] for _ in number]
    for r in pairs:
        asked[number[r["term"].encode()]].append(place[r["item_id"]])
    bagged = materialise(bags(docs, number, key, text))
    texts, total = bagged.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(number), np.int64)
    for r in bagged.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * texts + 2) / (2 * r["count"] + 1)))
    # A weight below zero cannot be: no more documents hold a term than there are.
    found = _score(classes(bagged, texts, total, best), weights, [np.array(a, np.int64) for a in asked], len(named), best)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= best)
    items = spark.createDataFrame(list(enumerate(named)), f"item int, item_id {item_kind}")
    return ranked.join(F.broadcast(items), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``best`` documents with a score above 0.

    Null and empty texts hold no terms, count for nothing and are never found; an item without terms, or that no document
    shares a term with, has no rows, and so has an empty table on either side. Every row of ``docs`` is a document of its
    own, repeated ids included; equal scores go by ascending id, null ids last. Rows of items that share an id (null
    included) are one item. Other columns are not looked at.
    """
    pairs = materialise(item_terms(items, item_key, item_text))
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    kind, found = items.schema[item_key].dataType.simpleString(), []
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        found.append(materialise(_search(docs, own, best, key, text, kind)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
