"""Near duplicates of vectors through hierarchical navigable small-world graphs.

Vectors are dealt into shards of bounded size and each shard gets a graph. Every vector queries every shard, in
blocks of queries; a beam that is full of links is widened for that query, and all beams of a task are
widened until an audit against brute force passes. Links are confirmed by cosine in double precision. A
task gives each query's number of links and joins up what it has linked, so that a group of copies never
becomes pairs; the joined pieces are then unioned over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import components, roots
from colloquy.llm.permutation import normal
from colloquy.llm.vectors import shards_for, sound, valid
from colloquy.plans.store import materialise

#: Neighbours a node chooses on insertion (twice as many are kept on the lowest level), and the beam it chooses from.
NEIGHBOURS, BUILD_BEAM = 16, 64
#: First beam of a query; doubled while needed. Past a quarter of the shard its vectors are compared one and all.
BEAM = 32
#: Queries of a task that are audited, and the share of their links that must be found.
AUDITED, RECALL = 512, 1.0
#: Queries in a block, and those that advance through a graph together.
BLOCK, TOGETHER = 1 << 14, 512


class Graph:
    """A graph over the rows of ``units`` (unit vectors). Rows are inserted in batches: each batch searches the graph
    so far, its rows also see each other, and all choose diverse neighbours at once."""

    def __init__(self, units: np.ndarray, links: list[np.ndarray] | None = None, levels: np.ndarray | None = None):
        self.units = np.ascontiguousarray(units, np.float32)
        n = len(units)
        if levels is None:
            draws = np.random.default_rng(11).random(n)
            levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(NEIGHBOURS)).astype(np.int32), 6)
            if n:
                levels[0] = levels.max()        # the entry reaches every level
        self.levels = levels
        self.top = int(levels.max(initial=0))
        self.links = links if links is not None else [np.full((n, NEIGHBOURS * (2 if level == 0 else 1)), -1, np.int32) for level in range(self.top + 1)]

    @classmethod
    def build(cls, units: np.ndarray) -> Graph:
        graph, at = cls(units), 1
        while at < len(units):
            size = min(256, max(16, at), len(units) - at)
            graph._insert(np.arange(at, at + size))
            at += size
        return graph

    def _insert(self, rows: np.ndarray) -> None:
        entry = np.zeros((len(rows), 1), np.int32)
        for level in range(self.top, -1, -1):
            mine = self.levels[rows] >= level
            beam = BUILD_BEAM if mine.any() else 4
            near, sims = self.search_level(self.units[rows], entry, beam, level)
            entry = near[:, :4]
            if mine.any():
                own = rows[mine]
                among = self.units[own] @ self.units[own].T
                np.fill_diagonal(among, -np.inf)
                cand = np.concatenate([near[mine], np.broadcast_to(own.astype(np.int32), (len(own), len(own)))], axis=1)
                score = np.concatenate([np.where(near[mine] >= 0, sims[mine], -np.inf), among], axis=1)
                keep = min(BUILD_BEAM, score.shape[1])
                best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
                self._connect(own, np.take_along_axis(cand, best, 1), np.take_along_axis(score, best, 1), level)

    def _choose(self, cand: np.ndarray, score: np.ndarray, most: int, diverse: int) -> np.ndarray:
        """Of candidates sorted by similarity, up to ``diverse`` that are closer to the node than to any chosen before, then the nearest of the rest."""
        vectors = self.units[np.maximum(cand, 0)]
        mutual = np.matmul(vectors, vectors.transpose(0, 2, 1))
        real = score > -np.inf
        nearest = np.full(score.shape, -np.inf, np.float32)
        taken, count = np.zeros(score.shape, bool), np.zeros(len(cand), int)
        for j in range(cand.shape[1]):
            take = real[:, j] & (count < diverse) & (nearest[:, j] < score[:, j])
            taken[:, j] = take
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, mutual[:, j]), nearest)
        rank = np.where(taken, 0, np.where(real, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((len(cand), most), -1, np.int32)
        out[:, :order.shape[1]] = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(cand, order, 1), -1)
        return out

    def _connect(self, own: np.ndarray, cand: np.ndarray, score: np.ndarray, level: int) -> None:
        links = self.links[level]
        chosen = self._choose(cand, score, NEIGHBOURS, NEIGHBOURS // 2 + 2)
        links[own, :NEIGHBOURS] = chosen
        # The other way round: all new neighbours of a node at once.
        to, back = chosen.ravel(), np.repeat(own, chosen.shape[1])
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, number = np.unique(to, return_index=True, return_counts=True)
        if not len(nodes):
            return
        wide = links.shape[1]
        number = np.minimum(number, wide * 2)
        more = np.full((len(nodes), int(number.max())), -1, np.int32)
        slot = np.arange(more.shape[1])[None, :] < number[:, None]
        more[slot] = back[(first[:, None] + np.arange(more.shape[1]))[slot]]
        both = np.concatenate([links[nodes], more], axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1       # a pair that chose each other
        sims = np.einsum("ijk,ik->ij", self.units[np.maximum(both, 0)], self.units[nodes])
        sims = np.where((both >= 0) & (both != nodes[:, None]), sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        links[nodes] = self._choose(np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1), wide, wide // 2)

    def search_level(self, queries: np.ndarray, entry: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes reached by each query from its entries, best first; -1 where fewer were."""
        b, links, units = len(queries), self.links[level], self.units
        seen = np.zeros((b, len(units)), bool)
        ids, sims, open_ = np.full((b, beam), -1, np.int32), np.full((b, beam), -np.inf, np.float32), np.zeros((b, beam), bool)

        def merge(rows: np.ndarray, found: np.ndarray) -> None:
            """Nodes ``found[i]`` of query ``rows[i]``, if not seen before, compete for its beam."""
            flat, owner = found.ravel(), np.repeat(rows, found.shape[1])
            fresh = flat >= 0
            fresh[fresh] = ~seen[owner[fresh], flat[fresh]]
            score = np.full(len(flat), -np.inf, np.float32)
            o, f = owner[fresh], flat[fresh]
            seen[o, f] = True
            score[fresh] = np.einsum("ij,ij->i", queries[o], units[f])
            score = score.reshape(found.shape)
            s = np.concatenate([sims[rows], score], axis=1)
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            sims[rows] = np.take_along_axis(s, top, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], found], axis=1), top, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], score > -np.inf], axis=1), top, 1)

        for j in range(entry.shape[1]):
            merge(np.arange(b), entry[:, j:j + 1])
        while True:
            waiting = np.where(open_, sims, -np.inf)
            at = waiting.argmax(axis=1)
            rows = np.flatnonzero(waiting[np.arange(b), at] > -np.inf)
            if not len(rows):
                break
            node = ids[rows, at[rows]]
            open_[rows, at[rows]] = False
            merge(rows, links[node])
        ids[sims == -np.inf] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = np.ascontiguousarray(queries, np.float32)
        entry = np.zeros((len(queries), 1), np.int32)
        for level in range(self.top, 0, -1):
            entry = self.search_level(queries, entry, 4, level)[0]
        return self.search_level(queries, entry, beam, 0)


def within(graph: Graph, units: np.ndarray, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, row)`` of all found with cosine of at least ``least``: beams full of links are doubled."""
    n, wide, todo, pairs = len(units), beam, np.arange(len(queries)), []
    slack = least - 1e-4        # single precision in the graph, double for the links
    while len(todo):
        if wide * 4 >= n:
            for lo in range(0, len(todo), 256):
                part = todo[lo:lo + 256]
                q, r = np.nonzero(queries[part] @ units.T >= slack)
                pairs.append((part[q], r))
            break
        full = []
        for lo in range(0, len(todo), TOGETHER):
            part = todo[lo:lo + TOGETHER]
            ids, sims = graph.search(queries[part], wide)
            hit = sims >= slack
            all_ = hit.all(axis=1)
            q, j = np.nonzero(hit & ~all_[:, None])
            pairs.append((part[q], ids[q, j]))
            full.append(part[all_])
        todo, wide = np.concatenate(full), wide * 2
    q, r = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, int)]) for k in (0, 1))
    exact = np.concatenate([np.einsum("ij,ij->i", queries[q[i:i + 65536]], units[r[i:i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    return q[exact >= least], r[exact >= least]


def audited(graph: Graph, units: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``within`` with the beam that finds the links of the audited queries."""
    sample = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)
    truth = sum(int((queries[sample[i:i + 64]] @ units.T >= least).sum()) for i in range(0, len(sample), 64))
    beam = BEAM
    while beam * 4 < len(units) and len(within(graph, units, queries[sample], least, beam)[0]) < RECALL * truth:
        beam *= 2
    return within(graph, units, queries, least, beam)


def _matrix(part: pa.Table) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("v").chunks]).reshape(part.num_rows, -1)


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors that are null, zero or hold null or non-finite components, rows without a key, and vectors of
    different lengths link with nothing. Rows with equal vectors are one node with their number;
    ``n_links`` counts all other rows linked directly. ``kept`` marks the smallest key of a component (all
    rows of it, if it repeats; a row without a key is never kept). An empty table gives no rows. Other columns are ignored.
    """
    keyed = materialise(valid(vectors, key, embedding).where("vec_id is not null"))
    nodes = keyed.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes)      # node numbers are fixed from here on
    n = nodes.count()
    shards, blocks = shards_for(n), max(1, -(-n // BLOCK))
    shard = F.pmod(F.xxhash64("rep", F.lit("shard")), F.lit(shards)).cast("int")
    dealt = nodes.withColumn("shard", shard)

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        graph = Graph.build(normal(_matrix(part)))
        flat = np.concatenate(graph.links, axis=1) if part.num_rows else np.zeros((0, 0), np.int32)
        return (part.select(["dim", "shard", "node", "copies", "v"]).append_column("place", pa.array(np.arange(part.num_rows), pa.int32()))
                .append_column("level", pa.array(graph.levels, pa.int32())).append_column("links", pa.array(list(flat), pa.list_(pa.int32()))))

    graphs = materialise(dealt.select("dim", "shard", "node", "copies", "v", "rep").groupBy("dim", "shard")
                         .applyInArrow(build, "dim int, shard int, node long, copies long, v array<double>, place int, level int, links array<int>"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        left = left.sort_by("place")
        levels = left.column("level").to_numpy()
        flat = np.concatenate([c.flatten().to_numpy() for c in left.column("links").chunks]).reshape(left.num_rows, -1)
        cuts = [NEIGHBOURS * 2, *[NEIGHBOURS] * int(levels.max())]
        links = [np.ascontiguousarray(part) for part in np.split(flat, np.cumsum(cuts)[:-1], axis=1)]
        units, queries = normal(_matrix(left)), normal(_matrix(right))
        ids, mine, copies = left.column("node").to_numpy(), right.column("node").to_numpy(), left.column("copies").to_numpy()
        q, r = audited(Graph(units, links, levels), units, queries, least)
        other = mine[q] != ids[r]
        q, r = q[other], r[other]
        number = np.bincount(q, copies[r], len(mine)).astype(np.int64)
        node, root = roots(mine[q], ids[r])
        count = np.zeros(len(node), np.int64)
        some = np.flatnonzero(number)
        count[np.searchsorted(node, mine[some])] = number[some]
        return pa.table({"node": node, "root": root, "n": count})

    keys = ("dim", "shard", "block")
    index = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (nodes.select("dim", "node", "v").withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = materialise(index.select(*keys, "node", "copies", "v", "place", "level", "links").groupBy(*keys)
                        .cogroup(asked.select(*keys, "node", "v").groupBy(*keys)).applyInArrow(run, "node long, root long, n long"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = (nodes.select("node", "v", "rep", "copies").join(links, "node", "left").join(groups, "node", "left")
               .select("node", "v", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    named = members.join(members.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("v", "n_links", "component_id")
    linked = keyed.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~sound(F.col(embedding)) | F.col(key).isNull()).select(F.col(key).alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col(key).alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")).withColumnRenamed("vec_id", key)
