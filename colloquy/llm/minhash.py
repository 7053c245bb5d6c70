"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its k smallest. Inverted lists of the
retained values bring documents together, the k smallest of two sketches' union estimate their
similarity, and pairs that may reach the threshold are confirmed on their whole shingle sets.

Equal sets are one class from the start, values that only one class retains are left out, and each class is
listed only under its rarest values (so many that two classes above the threshold must meet). Lists
are never turned into pairs: classes first meet their list's smallest member; lists that
this joins up are done, and the others are compared as matrices inside tasks, which give forests of links.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Memory, components, maybe_broadcast, roots
from colloquy.plans.store import materialise

#: Words of a shingle, and values a sketch retains.
WORDS, RETAINED = 5, 64
#: An estimate may fall this far below the threshold by chance (below 1e-8 for a pair at the threshold).
MARGIN = 35
#: Larger families are compared in blocks of so many classes.
BLOCK = 1024
#: Bytes of words and hashes that a worker remembers.
MEMORY = 48 << 20


@lru_cache(maxsize=1)
def _hashes() -> Memory:
    return Memory(xxhash.xxh3_64_intdigest, MEMORY, 170)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles (of all its words, if it has fewer)."""
    words = (text or "").encode().lower().split()       # lowers A-Z, splits at ASCII white space
    if not words:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i:len(words) - width + 1 + i]
    # Spread all bits, so that the smallest values are a fair draw.
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed.view(np.int64))


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text_key, set_key, n, sketch)`` per row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, digest, kept = [], [], []
            for value in batch.column(2):
                own = shingles(value.as_py())
                n.append(len(own)), digest.append(hashlib.md5(own.tobytes()).digest()), kept.append(own[:RETAINED])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                                             names=["doc_id", "text_key", "set_key", "n", "sketch"])
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, text_key long, set_key binary, n long, sketch array<long>")


def _needed_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``(id, items)``: the whole shingle sets of the classes ``wanted(id, text_key, set_key)``, from their texts."""
    def run(batches):
        for batch in batches:
            sets = [shingles(value.as_py()) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "items"])
    keyed = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    texts = keyed.join(maybe_broadcast(wanted.select("text_key").distinct()), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    sets = texts.select("text").mapInArrow(run, "set_key binary, items array<long>")
    return wanted.join(sets, "set_key").groupBy("id").agg(F.first("items").alias("items"))


def _least_overlap(n: Column, percent: int) -> Column:
    """Retained values that a class of ``n`` shingles shares at least with any class above the threshold."""
    # The largest partner may hold as many shared values beyond its sketch as it is larger than that.
    beyond = F.greatest(F.floor(n * 100 / percent) - RETAINED, F.lit(0))
    whole = F.least(F.ceil(n * percent / 100), n - beyond)
    return F.greatest(F.when(n <= RETAINED, whole).otherwise(RETAINED * (percent - MARGIN) // 100 + 1), F.lit(1)).cast("int")


def _compatible(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose whole sets reach the threshold. The union-sketch estimate goes first."""
    side = lambda name: classes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_compatible(F.col("n_a"), F.col("n_b"), percent))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, RETAINED)
    both = both.withColumn("u", union).withColumn("hits", F.size(F.filter(F.array_intersect("s_a", "s_b"), lambda x: x <= F.element_at("u", -1))))
    likely = both.where(F.when(F.size("u") < RETAINED, F.col("hits") * 100 >= F.size("u") * percent).otherwise(F.col("hits") * 100 >= RETAINED * (percent - MARGIN)))
    full = lambda name: sets.select(F.col("id").alias(name), F.col("items").alias(f"i_{name}"))
    met = likely.select("a", "b", "n_a", "n_b").join(full("a"), "a").join(full("b"), "b").withColumn("common", F.size(F.array_intersect("i_a", "i_b")).cast("bigint"))
    return met.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """``(value, id, n)``: inverted lists of at least two classes, each class under its rarest retained values."""
    kept = classes.select("id", "n", F.explode("sketch").alias("value"))
    often = kept.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = kept.join(often, "value")
    order = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))       # at most k a class
    retained = F.least(F.col("n"), F.lit(RETAINED)).cast("int")
    room = retained - _least_overlap(F.col("n"), percent) + 1 - (retained - F.size("v"))        # values that no other class has come first
    listed = materialise(order.where(room > 0).select("id", "n", F.explode(F.slice("v", F.lit(1), room)).alias("v")).select(F.col("v.value").alias("value"), "id", "n"))
    # Lists with the same members are one list.
    marks = listed.groupBy("value").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.min("n").alias("n_lo"))
    one = marks.where("m > 1").groupBy("m", "lo", "hi", "s").agg(F.min("value").alias("value"))
    return listed.join(one.select("value", "m"), "value")


def _families(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``(id, n, fam)`` of the classes that may still be linked: families are joined by common lists, and those are
    left out that are one group by now or have two members, which have met."""
    grouped = lists.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("grp", F.coalesce("component", "id"))
    still = grouped.groupBy("value").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("id").alias("lead")).where("lo != hi").select("value", "lead")
    met = materialise(grouped.join(still, "value").select("id", "n", "grp", "lead").distinct())
    fams = components(met.select(F.col("lead").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("fam"))
    members = materialise(met.select("id", "n").distinct().join(fams, "id"))
    return members.join(members.groupBy("fam").agg(F.count("*").alias("m")), "fam").where("m > 2")


def _compare(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside families, ``(a, b)``: whole sets are compared all at once, and what a task finds linked is given as a forest.

    A family of up to ``BLOCK`` is one task's; of larger ones, classes of like sizes meet block by block.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.0001)).cast("int")     # links reach the next step at most
    rows = members.withColumn("step", F.when(F.col("m") > BLOCK, step).otherwise(0))
    cells = rows.groupBy("fam", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = lambda by, name: cells.select("fam", (F.col("step") + by).alias("step"), F.col("blocks").alias(name))
    rows = rows.join(near(0, "own"), ["fam", "step"]).join(near(-1, "up"), ["fam", "step"], "left").join(near(1, "down"), ["fam", "step"], "left")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    def to(count, make):
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<s:int,i:int,t:int,j:int>>"))
    cell = lambda s, i, t, j: F.struct(s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"))
    s, i = F.col("step"), F.col("mine")
    keys = F.concat(to("own", lambda j: cell(s, F.least(i, j), s, F.greatest(i, j))), to("up", lambda j: cell(s, i, s + 1, j)), to("down", lambda j: cell(s - 1, j, s, i)))
    dealt = rows.withColumn("c", F.explode(keys)).select("fam", "c.s", "c.i", "c.t", "c.j", "id", "n").join(sets, "id")

    def run(group: pa.Table) -> pa.Table:
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        member = np.repeat(np.arange(len(ids)), n)
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("items").chunks])
        _, column, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[column] > 1
        member, column = member[shared], np.unique(column[shared], return_inverse=True)[1]
        common = np.zeros((len(ids), len(ids)), np.float32)     # exact up to 2**24 shingles
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for lo in range(0, int(column.max(initial=-1)) + 1, 4096):
            at = slice(*np.searchsorted(column, [lo, lo + 4096]))
            part = np.zeros((len(ids), 4096), np.float32)
            part[member[at], column[at] - lo] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        linked = (common * 100 >= (n[:, None] + n[None, :] - common) * percent)
        a, b = np.nonzero(np.triu(linked, 1))
        node, root = roots(ids[a], ids[b])
        return pa.table({"a": node, "b": root})

    return dealt.groupBy("fam", "s", "i", "t", "j").applyInArrow(run, "a long, b long").where("a != b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, text_key: bool = False) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``docs``; with ``text_key`` also the hash of its text.

    Rows are linked if 100 times the shingles they share is at least ``percent`` times the shingles of either;
    ``component_id`` is the smallest key reachable by links, and the row of that key is kept.
    Null, empty and blank texts have no shingles and are components of their own. Repeated rows of the
    smallest key are all kept. A row without a key takes its component's smallest one and is kept only
    where the component has no key at all. Other columns are ignored. An empty table gives no rows.
    """
    rows = materialise(_sketches(docs, key, text))
    classes = (rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
               .withColumn("id", F.monotonically_increasing_id()))
    classes = materialise(classes)      # ids are fixed from here on
    lists = materialise(_lists(classes, percent))
    wanted = materialise(lists.select("id").distinct().join(classes.select("id", "text_key", "set_key"), "id"))
    sets = materialise(_needed_sets(docs, text, wanted))
    # Each class and the smallest class of its list.
    lead = lists.groupBy("value").agg(F.min("id").alias("a"))
    first = lists.join(lead, "value").where("id != a").select("a", F.col("id").alias("b")).distinct()
    links = materialise(_confirm(first, classes, sets, percent))
    groups = materialise(components(links))
    more = materialise(_compare(materialise(_families(lists, groups)), sets, percent))
    if not more.isEmpty():
        groups = materialise(components(links.unionByName(more)))
    members = classes.select("set_key", "id", "rep").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = members.join(least, "component").select("set_key", "component_id")
    own = ["doc_id", "text_key", F.col("n").alias("n_shingles")]
    out = rows.select("doc_id", "text_key", "set_key", "n").where("n > 0").join(named, "set_key").select(*own, "component_id")
    out = out.unionByName(rows.where("n = 0").select(*own, F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      *(["text_key"] if text_key else []))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, one of those repeated with key and text.

    Rows go by an anti-join with the dropped keys, which are far fewer than the rows, so that texts are not shuffled
    while those can be broadcast.
    """
    found = materialise(near_duplicates(docs, key, text, percent, text_key=True).select(F.col(key).alias("dup_key"), F.col("text_key").alias("dup_text"), "kept"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("dup_key")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("dup_text"))
    dropped = materialise(found.where(~F.col("kept")).select("dup_key", "dup_text").distinct())
    again = materialise(found.where("kept and dup_key is not null").groupBy("dup_key", "dup_text").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    stay = docs.join(maybe_broadcast(dropped), same, "left_anti")
    repeated = docs.join(maybe_broadcast(again), same, "left_semi")
    one = repeated.withColumn("dup_text", F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([key, "dup_text"]).drop("dup_text")
    return stay.join(maybe_broadcast(again), same, "left_anti").unionByName(one)
