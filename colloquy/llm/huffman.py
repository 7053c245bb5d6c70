"""Token ids as canonical length-limited Huffman codes, in blocks that are read on their own.

A store is a folder with two tables: ``code`` has a row per id that occurs (its code's length; canonical
codes follow from the lengths), ``blocks`` has runs of documents in ascending order: their ids and lengths,
the bits, and the bit offset of every 256th id of each document, from which a table-driven decoder
steps through all runs side by side.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.tokens import encoder
from colloquy.plans.store import shared_dir

#: Longest code in bits: the decoder's table has two to this power entries.
LONGEST = 18
#: Bytes of text that are encoded at a time, and ids that are coded at a time, about.
ENCODED, CODED = 8 << 20, 1 << 21
#: Ids between checkpoints, and ids after which a block is closed.
STRIDE, BLOCK = 256, 1 << 18


def lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths of least total size with none over ``longest``, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes longer than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    merged, leaves = weights, [np.ones(len(order), bool)]
    for _ in range(longest - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        leaves.append(at < len(weights))
    take = 2 * len(order) - 2
    for level in reversed(leaves):
        single = int(level[:take].sum())
        out[order[:single]] += 1
        take = 2 * (take - single)
    return out


def canonical(lens: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    used = np.flatnonzero(lens)
    order = used[np.lexsort((used, lens[used]))]
    codes, code, last = np.zeros(len(lens), np.uint64), 0, 0
    for i in order.tolist():
        code <<= int(lens[i]) - last
        codes[i], last = code, int(lens[i])
        code += 1
    return codes


def pack(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids`` in whole big-endian 32-bit words, and the bit offset of every ``STRIDE``-th id."""
    data, _, at, _ = pack_many(ids, np.array([len(ids)]), lens, codes)
    return data, at


def pack_many(ids: np.ndarray, sizes: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of documents of ``sizes`` ids one behind the other, each in whole big-endian 32-bit words of its own.

    Gives the words, how many each document has, the bit offset of every ``STRIDE``-th id within its document, and how many offsets each has.
    """
    marks = -(-sizes // STRIDE)
    if not len(ids):
        return b"", np.zeros(len(sizes), np.int64), np.zeros(0, np.int64), marks
    size = lens[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(sizes)
    first = last - sizes
    n = (ends[last] - ends[first] + 31) >> 5                # words of each document
    own = ends[first]                                       # where its bits would start without padding
    starts = ends[:-1] - np.repeat(own, sizes)
    base = np.cumsum(n) - n
    wide = codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
    word, total = (starts >> 5) + np.repeat(base, sizes), int(n.sum())
    # Every word holds the first bits of some id, and at most the last bits of one more; no two overlap.
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), total) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), total + 1)[:total]
    step = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
    return words.astype(np.int64).astype(">u4").tobytes(), n, starts[np.repeat(first, marks) + step * STRIDE], marks


def decode_table(lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each run of ``LONGEST`` bits the id it starts with, and that id's length in the low five bits."""
    table = np.zeros(1 << LONGEST, np.uint32)
    used = np.flatnonzero(lens)
    order = used[np.lexsort((used, lens[used]))]
    spans = 1 << (LONGEST - lens[order])
    filled = np.repeat(order.astype(np.uint32) << np.uint32(5) | lens[order].astype(np.uint32), spans)
    table[:len(filled)] = filled
    return table


def unpack(data: bytes, offsets: np.ndarray, runs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of all runs, one behind the other: run ``i`` has ``runs[i]`` ids from bit ``offsets[i]``. All runs advance a step at a time."""
    words = np.frombuffer(data, ">u4").astype(np.uint64)
    pairs = words << np.uint64(32)
    pairs[:-1] |= words[1:]
    out = np.zeros(int(runs.sum()), np.uint32)
    # Longer runs first, so that those still open at a step are a prefix.
    order = np.argsort(-runs, kind="stable")
    to, at = (np.cumsum(runs) - runs)[order], offsets[order].astype(np.int64)
    open_at = np.searchsorted(-runs[order], -np.arange(int(runs.max(initial=0))), side="left")
    mask = np.uint64((1 << LONGEST) - 1)
    for step, n in enumerate(open_at.tolist()):
        p = at[:n]
        entry = table[((pairs[p >> 5] >> (64 - LONGEST - (p & 31)).astype(np.uint64)) & mask).astype(np.int64)]
        out[to[:n] + step] = entry >> np.uint32(5)
        at[:n] += (entry & np.uint32(31)).astype(np.int64)
    return out


def _runs(sizes: np.ndarray) -> np.ndarray:
    """How many ids lie between the checkpoints of documents of these sizes."""
    n = -(-sizes // STRIDE)
    runs = np.full(int(n.sum()), STRIDE, np.int64)
    last = np.cumsum(n) - 1
    some = sizes > 0
    runs[last[some]] = (sizes - (n - 1) * STRIDE)[some]
    return runs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _ends(sizes: np.ndarray) -> pa.Array:
    """Offsets of an Arrow list or binary column of these sizes."""
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _groups(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """First row, and the one behind the last, of groups of whole rows of some ``most`` together."""
    bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(sizes)]
    return list(zip(bounds, bounds[1:])) if len(sizes) else []


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key long, ids binary, counts binary)``: little-endian ids of every whole text (null: empty), then ``end_id``.

    Each task ends with a row of how often it gave each id (64-bit integers) and no ids.
    """
    def run(batches):
        use = encoder(vocabulary)
        end = np.array([end_id], use.width).tobytes()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi in _groups(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64), ENCODED):
                ids = use.column(batch.column(1).slice(lo, hi - lo), end)
                stop = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[-1]
                own = np.bincount(np.frombuffer(ids.buffers()[2][:stop], use.width), minlength=len(total))
                own[:len(total)] += total
                total = own
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, pa.nulls(len(ids), pa.binary())], names=["key", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["key", "ids", "counts"])
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids binary, counts binary")


def count_ids(ids: DataFrame, size: int) -> np.ndarray:
    """How often each of ``size`` ids occurs in all rows, from the counts that the encoding tasks left; the ids themselves are not read."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in batch.column(0):
                own = np.frombuffer(part.as_py(), "<i8")
                total[:len(own)] += own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])
    rows = ids.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()     # a row per id of the vocabulary
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode ``docs`` and write the store at ``path``, in ascending ``key`` order (nulls first, equal keys in any order).

    Ids are kept once on shared storage, counted, coded, and dealt out by ranges of the key.
    """
    spark = docs.sparkSession
    size = max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1)
    width = encoder(vocabulary).width
    plain, coded = f"{path}/ids", f"{path}/coded"
    tokenize(docs, vocabulary, end_id, key, text).write.option("compression", "zstd").parquet(plain)
    ids = spark.read.parquet(plain)
    lens = lengths(count_ids(ids, size))
    used = np.flatnonzero(lens)
    spark.createDataFrame([(int(i), int(lens[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((lens, canonical(lens)))        # as long as the vocabulary

    def code(batches):
        lens, codes = shared.value
        for batch in batches:
            held = batch.column(1)
            sizes = pc.binary_length(held).to_numpy().astype(np.int64) // np.dtype(width).itemsize
            for lo, hi in _groups(sizes, CODED):        # some millions of ids at a time, whole documents
                own = np.frombuffer(b"".join(held.slice(lo, hi - lo).to_pylist()), width).astype(np.int64)
                data, n, at, marks = pack_many(own, sizes[lo:hi], lens, codes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi].astype(np.int32)), pa.ListArray.from_arrays(_ends(marks), pa.array(at.astype(np.int64))),
                     pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(_ends(4 * n).to_numpy()), pa.py_buffer(data)])],
                    names=["key", "n", "offsets", "bits"])

    ids.where("ids is not null").select("key", "ids").mapInArrow(code, "key long, n int, offsets array<long>, bits binary").write.option("compression", "none").parquet(coded)
    _delete(spark, plain)

    def blocks(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        keys, sizes, offsets, bits, n, at = [], [], [], [], 0, 0

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([np.concatenate(offsets) if offsets else np.zeros(0, np.int64)], pa.list_(pa.int64())), pa.array([b"".join(bits)], pa.binary())],
                names=["part", "block", "first", "keys", "sizes", "offsets", "bits"])

        for batch in batches:
            for key, size, own, data in zip(*(c for c in batch.columns)):
                keys.append(key.as_py()), sizes.append(size.as_py()), bits.append(data.as_py())
                offsets.append(own.values.to_numpy(zero_copy_only=False) + at * 8)
                n, at = n + sizes[-1], at + len(bits[-1])
                if n >= BLOCK:
                    yield close()
                    block, first = block + 1, first + n
                    keys, sizes, offsets, bits, n, at = [], [], [], [], 0, 0
        if keys:
            yield close()

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (spark.read.parquet(coded).repartitionByRange(parts, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
     .mapInArrow(blocks, "part int, block int, first long, keys array<long>, sizes array<int>, offsets array<long>, bits binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    _delete(spark, coded)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of the store: ids as an array, or with ``digest`` their CRC32 as ``ids_crc32``.

    Any block is decoded without the others; where a document starts is its block's place in its
    part, added to the parts before.
    """
    code = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/code").collect()}       # as long as the vocabulary
    lens = np.zeros(max(code, default=-1) + 1, np.int64)
    lens[list(code)] = list(code.values())
    shared = spark.sparkContext.broadcast(lens)
    out = "ids_crc32" if digest else "ids"

    def run(batches):
        table = _table(shared.value.tobytes())
        for batch in batches:
            for part, first, keys, sizes, offsets, bits in zip(*batch.columns):
                sizes = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = unpack(bits.as_py(), offsets.values.to_numpy(zero_copy_only=False), _runs(sizes), table)
                ends = np.cumsum(sizes)
                own = [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                last = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in own], pa.int64()) if digest else pa.array(own, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(np.full(len(own), part.as_py()), pa.int32()), pa.array(first.as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), last],
                                                 names=["doc_id", "part", "within", "n_tokens", out])

    blocks = spark.read.parquet(f"{path}/blocks")
    docs = blocks.select("part", "first", "keys", "sizes", "offsets", "bits").mapInArrow(run, f"doc_id long, part int, within long, n_tokens long, {out} {'long' if digest else 'array<int>'}")
    totals = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))         # a row per part
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", out)


@lru_cache(maxsize=2)
def _table(lens: bytes) -> np.ndarray:
    own = np.frombuffer(lens, np.int64)
    return decode_table(own, canonical(own))


def store(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as a store and read its digest back. An empty table gives no rows."""
    import uuid
    path = path or f"{shared_dir(docs.sparkSession)}/huffman-{uuid.uuid4().hex}"
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path, digest=True)
