"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a row belongs to the first point at or after its own
position. A shard takes rows up to its capacity, and what overflows continues clockwise to the
next points whose shards have room. Rows between two neighbouring points are alike, so the
overflow is settled on their counts (a table bounded by the number of points), and each row
only needs its rank between its two points.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.store import materialise

#: Positions are the first 60 bits of an MD5.
POSITION_BITS = 60


def points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """``(position, shard)`` of every virtual node, in ring order."""
    return sorted((int(hashlib.md5(f"{shard}:{v}".encode()).hexdigest()[:15], 16), shard) for shard in range(shards) for v in range(vnodes))


def position(key: Column) -> Column:
    """A row's place on the ring; a null key has one too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may take: the even share and ``slack`` of it more; without slack they add up to ``rows``."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """``(arc, first rank, end rank, shard)``: first each shard takes from its own arcs in ring order,
    then the rest of each arc goes clockwise to points whose shards have room."""
    room, left, out, n = list(room), [], [], len(counts)
    for arc, count in enumerate(counts):
        take = min(count, room[owners[arc]])
        room[owners[arc]] -= take
        if take:
            out.append((arc, 0, take, owners[arc]))
        left.append(take)
    for arc, count in enumerate(counts):
        at, rank = arc, left[arc]
        while rank < count:
            at = (at + 1) % n
            take = min(count - rank, room[owners[at]])
            if take:
                room[owners[at]] -= take
                out.append((arc, rank, rank + take, owners[at]))
                rank += take
    return out


def _arc(ring: list[tuple[int, int]], place: Column, bits: int) -> Column:
    """Index of the first point at or after ``place``: the points of its slice of the ring are compared."""
    places, step = [p for p, _ in ring], POSITION_BITS - bits
    slices = []
    for i in range(1 << bits):
        lo, hi = bisect_left(places, i << step), bisect_left(places, (i + 1) << step)
        slices.append((lo, places[lo:hi]))
    base = F.array(*[F.lit(lo) for lo, _ in slices])
    inside = F.from_json(F.lit(str([p for _, p in slices])), "array<array<bigint>>")
    cell = F.shiftright(place, step).cast("int")
    return ((F.get(base, cell) + F.size(F.filter(F.get(inside, cell), lambda x: x < place))) % len(ring)).cast("int")


def place(df: DataFrame, shards: int, key: str = "doc_id", within: tuple[str, ...] = (), vnodes: int = 64, slack: float = 0.0,
          rank_bits: int = 16) -> DataFrame:
    """``(key, *within, shard, slot)``, one row per row of ``df``.

    ``key`` decides the place on the ring; equal places are ranked by ``key`` and the columns
    ``within`` (any cheap ones that tell rows apart). Rows equal in all of them are
    interchangeable: they are counted before anything is shuffled and dealt out again at the end, so one
    repeated row never fills a task. Nulls are keys like others. An empty table gives no rows.
    ``slack`` 0 makes the counts of shards differ by one at most; with more, rows move less when
    shards are added. Slots number a shard's rows from 0. Other columns of ``df`` are ignored, whatever
    their names.
    """
    spark, cols = df.sparkSession, [key, *within]
    ring = points(shards, vnodes)
    owners = [shard for _, shard in ring]
    keys = df.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.count("*").alias("copies"))
    keys = materialise(keys.withColumn("place", position(F.col("k0"))).withColumn("arc", _arc(ring, F.col("place"), 8))
                       .withColumn("cell", F.shiftright("place", POSITION_BITS - rank_bits).cast("int")))
    cells = keys.groupBy("arc", "cell").agg(F.sum("copies").alias("n"))
    # The arc that closes the ring starts behind the last point: its high cells come first.
    first = F.when(F.col("cell") >= ring[-1][0] >> (POSITION_BITS - rank_bits), 0).otherwise(1)
    cells = cells.withColumn("turn", F.when(F.col("arc") == 0, first).otherwise(0))
    ahead = F.sum("n").over(Window.partitionBy("arc").orderBy("turn", "cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    totals = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}     # a row per point at most
    counts = [totals.get(i, 0) for i in range(len(ring))]
    dealt = settle(counts, owners, capacities(sum(counts), shards, slack))
    start, rows = [0] * shards, []
    for arc, lo, hi, shard in sorted(dealt, key=lambda x: (x[3], x[0], x[1])):
        rows.append((arc, lo, hi, shard, start[shard]))
        start[shard] += hi - lo
    literal = F.from_json(F.lit(str([list(r) for r in rows])), "array<array<bigint>>")
    runs = (spark.range(1).select(F.explode(literal).alias("r"))
            .select(F.get("r", F.lit(0)).cast("int").alias("arc"), F.struct(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(("lo", "hi", "shard", "first"), 1)]).alias("run"))
            .groupBy("arc").agg(F.collect_list("run").alias("runs")))
    order = Window.partitionBy("arc", "cell").orderBy("place", *[f"k{i}" for i in range(len(cols))]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (keys.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0)))
              .join(cells.select("arc", "cell", "ahead"), ["arc", "cell"])
              .withColumn("rank", F.explode(F.expr("sequence(ahead + before, ahead + before + copies - 1)"))))
    mine = F.get(F.filter("runs", lambda r: (F.col("rank") >= r["lo"]) & (F.col("rank") < r["hi"])), F.lit(0))
    return (ranked.join(F.broadcast(runs), "arc").withColumn("run", mine)        # bounded by points and shards
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(cols)], F.col("run.shard").cast("int").alias("shard"),
                    (F.col("run.first") + F.col("rank") - F.col("run.lo")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = 0.0) -> DataFrame:
    """Placement of ``documents`` with size (UTF-8 bytes and 1; a null text has none) and the text's CRC32."""
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
                        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = place(sized, shards, "doc_id", ("size", "text_crc32"), slack=slack)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
