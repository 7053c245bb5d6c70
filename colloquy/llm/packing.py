"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

A bin holds at most one piece of a source and one of a duplicate cluster. Bins are ordered by the room they have
left; for each piece, longest first, the search starts at the smallest room it fits and continues upwards until
a bin without its source and cluster is found, which is the tightest compatible one.

Rows are dealt into groups of bounded size by a hash, so that a source or cluster of any size is spread over
all of them; each group is packed on its own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.store import materialise

#: Pieces a group has on average.
GROUP = 8192
#: The sources with most pieces of a group have tables of rooms; the others, with few pieces each, walk the open rooms.
TABLES = 512


class Bins:
    """Open bins of one group, by the room they have left.

    Every source has a bit of its own, without a limit; a piece without a source has none and conflicts with no
    bin for it. ``free[s]`` is a bitmap over room sizes: bit r is set if some bin with room r lacks source bit s, so the
    next candidate room is found by a shift. Bits from ``TABLES`` on use ``open``, the rooms of any bin: such a source
    is in few bins, so that few rooms are walked in vain. Bins of a room are kept by their source bitmap, and each bin
    carries the bitmap of its clusters (bits numbered as clusters appear in the group).
    """

    def __init__(self, capacity: int):
        self.capacity, self.sources, self.clusters, self.used = capacity, [], [], []
        self.by_room: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.lacking: dict[int, dict[int, int]] = {}      # source bit -> room -> bins
        self.free: dict[int, int] = {}
        self.bins_of: dict[int, int] = defaultdict(int)   # room -> bins
        self.open = 0

    def _count(self, bit: int) -> None:
        """Start counting for a source when it first appears: no bin has it yet."""
        rooms = {room: sum(map(len, bins.values())) for room, bins in self.by_room.items() if bins}
        self.lacking[bit] = defaultdict(int, rooms)
        self.free[bit] = sum(1 << room for room in rooms)

    def _shift(self, room: int, sources: int, by: int) -> None:
        self.bins_of[room] += by
        if by > 0:
            self.open |= 1 << room
        elif not self.bins_of[room]:
            self.open &= ~(1 << room)
        for bit, counts in self.lacking.items():
            if not sources >> bit & 1:
                counts[room] += by
                if by > 0:
                    self.free[bit] |= 1 << room
                elif not counts[room]:
                    self.free[bit] &= ~(1 << room)

    def find(self, size: int, bit: int | None, cluster: int) -> int | None:
        """The tightest bin that fits ``size`` and has neither the source nor the cluster."""
        if bit is not None and bit < TABLES and bit not in self.lacking:
            self._count(bit)
        mask = self.free.get(bit, self.open) >> size << size
        while mask:
            room = (mask & -mask).bit_length() - 1
            found = None
            for sources, bins in self.by_room[room].items():
                if bit is None or not sources >> bit & 1:
                    own = min((b for b in bins if not self.clusters[b] >> cluster & 1), default=None)
                    if own is not None and (found is None or own < found):
                        found = own
            if found is not None:
                return found
            mask &= mask - 1
        return None

    def put(self, size: int, bit: int | None, cluster: int) -> tuple[int, int]:
        """``(bin, offset)`` of a piece; ``bit`` is null without a source."""
        at = self.find(size, bit, cluster)
        if at is None:
            at = len(self.used)
            self.sources.append(0), self.clusters.append(0), self.used.append(0)
        else:
            room = self.capacity - self.used[at]
            own = self.by_room[room][self.sources[at]]
            own.remove(at)
            if not own:
                del self.by_room[room][self.sources[at]]
            self._shift(room, self.sources[at], -1)
        offset = self.used[at]
        self.used[at] += size
        self.sources[at] |= 0 if bit is None else 1 << bit
        self.clusters[at] |= 1 << cluster
        room = self.capacity - self.used[at]
        if room:        # a full bin is closed
            self.by_room[room][self.sources[at]].append(at)
            self._shift(room, self.sources[at], 1)
        return at, offset


def best_fit(sizes: Iterable[int], sources: Iterable, clusters: Iterable, capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each piece, in the order given. A null source conflicts with nothing."""
    sources = list(sources)
    # Bits by number of pieces; a source with one piece conflicts with nothing either.
    often = Counter(s for s in sources if s is not None).most_common()
    bins, bits, marks = Bins(capacity), {s: i for i, (s, n) in enumerate(often) if n > 1}, {}
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        out.append(bins.put(size, bits.get(source), marks.setdefault(cluster, len(marks))))
    return out


def pack(items: DataFrame, key: str, size: str, source: str, cluster: str, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """``(key, piece, size, source, cluster, bin, offset)``: a row per piece of each row of ``items``.

    Rows longer than ``capacity`` are cut into full pieces and a rest; full pieces have bins of their own.
    Rows without a size or with one below 1 are given size 1 (an end mark). A null source or cluster conflicts with nothing:
    each such piece counts as one of its own. Repeated rows are packed once each. Bins are numbered from 0 without
    gaps: those of each group in turn, then the full ones. An empty table gives no rows.
    """
    # A row's hash deals it out; repeated rows get numbers of their own by where they are read.
    rows = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(1)), F.lit(1)).alias("size"),
                        F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    groups = max(1, -(-n // group))
    full = F.floor(F.col("size") / capacity).cast("bigint")
    whole = (rows.where(full > 0).select("key", "source", "cluster", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), "row")
             .select("key", F.col("piece").cast("int"), F.lit(capacity).cast("bigint").alias("size"), "source", "cluster", "row"))
    rest = rows.select("key", full.cast("int").alias("piece"), (F.col("size") % capacity).alias("size"), "source", "cluster", "row").where("size > 0")
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("key", "size", "source", "cluster", "row"), F.lit(groups)).cast("int"))
    kind = items.schema[key].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("size", "descending"), ("cluster", "ascending"), ("source", "ascending"), ("key", "ascending"), ("row", "ascending")])
        sources, clusters = part.column("source").to_pylist(), part.column("cluster").to_pylist()
        alone = range(len(clusters))
        placed = best_fit(part.column("size").to_pylist(), sources, [(i, None) if c is None else c for i, c in zip(alone, clusters)], capacity)
        bins, offsets = (np.array([p[k] for p in placed], np.int64) for k in (0, 1))
        return part.select(["key", "piece", "size", "source", "cluster", "grp"]).append_column("local", pa.array(bins)).append_column("offset", pa.array(offsets))

    placed = materialise(rest.groupBy("grp").applyInArrow(run, f"key {kind}, piece int, size long, source string, cluster string, grp int, local long, offset long"))
    counts = placed.groupBy("grp").agg((F.max("local") + 1).alias("bins"))
    # A row per group: few thousand times fewer than the pieces, summed in two steps.
    step = F.floor(F.col("grp") / 4096).alias("step")
    counts = counts.withColumn("step", step)
    inside = F.coalesce(F.sum("bins").over(Window.partitionBy("step").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.groupBy("step").agg(F.sum("bins").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.withColumn("inside", inside).join(F.broadcast(steps.select("step", before.alias("before"))), "step").select("grp", (F.col("inside") + F.col("before")).alias("base"))
    mixed = placed.join(base, "grp").select("key", "piece", "size", "source", "cluster", (F.col("base") + F.col("local")).alias("bin"), "offset")
    used = counts.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("n")).first()["n"]
    # Full pieces: numbered by row and piece, each row's first number from the sums of the rows' blocks before.
    own = rows.where(full > 0).select("row", full.alias("n")).withColumn("blk", F.shiftright("row", 12))
    blocks = own.groupBy("blk").agg(F.sum("n").alias("n")).withColumn("top", F.shiftright("blk", 21))      # the partition that numbered the row
    tops = blocks.groupBy("top").agg(F.sum("n").alias("n"))
    tops = tops.select("top", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("t"))
    blocks = blocks.withColumn("b", F.coalesce(F.sum("n").over(Window.partitionBy("top").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(F.broadcast(tops), "top")
    first = own.withColumn("r", F.coalesce(F.sum("n").over(Window.partitionBy("blk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = first.join(blocks.select("blk", "b", "t"), "blk").select("row", (F.col("r") + F.col("b") + F.col("t") + used).alias("first"))
    alone = whole.join(first, "row").select("key", "piece", "size", "source", "cluster", (F.col("first") + F.col("piece")).alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    return mixed.unionByName(alone).withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(doc_id, piece, size, bin, offset)`` of ``documents``: sizes are words and an end mark, clusters are
    texts that are equal but for case and white space (empty ones belong to none)."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    words = F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, 0).otherwise(F.size(F.split(plain, " ")))
    items = docs.select("doc_id", (words + 1).cast("bigint").alias("size"), "source", F.when(plain != "", F.md5(plain)).alias("cluster"))
    return pack(items, "doc_id", "size", "source", "cluster", capacity).select("doc_id", "piece", "size", "source", "cluster", "bin", "offset")
