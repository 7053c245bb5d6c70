"""BPE by content-defined chunks: what documents share is encoded once, and the joins of chunks are repaired.

A rolling hash over the last 32 bytes cuts texts wherever its top bits are zero, so that equal passages are cut alike in whatever
document they stand. Chunks that occur more than once travel by their digest to one place and are encoded there; all
others are encoded where they are. A chunk is cut anywhere, also inside a word, so the ids around a join are those of
another text: the join is encoded again in a window that widens until it ends at gaps on both sides. No piece of the
vocabulary crosses a gap (this is tested when it is loaded), so there the ids agree with those of the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Tokenizer

from colloquy.llm.tokens import byte_chars
from colloquy.plans.store import materialise

#: Bytes the rolling hash looks at, the least and the greatest length of a chunk, and the bits that are zero at a cut (1 KB apart).
WINDOW, LEAST, GREATEST, BITS = 32, 128, 8192, 10
#: The filter of shared chunks has so many bits at most. If it fills up, more chunks take the way of the shared ones.
FILTER_BITS = 1 << 26
#: Chunks with over one in so many occurrences are dealt over several tasks; there are at most so many of them.
HOT = 2000
#: Bytes of words and ids a worker remembers, from one task to the next, in two generations.
MEMORY = 64 << 20
#: White space that texts are split at: what Python takes for it but the four separators that vocabularies do not.
GAPS = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SEPARATORS = "\x1c\x1d\x1e\x1f"
_GAP = re.compile(f"[{''.join(GAPS)}]+")
_MIX = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
_GEAR = ((_MIX ^ (_MIX >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' values, each shifted by its distance: doubled five times from single bytes."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def cuts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text. A cut depends only on the 32 bytes before it and on where the chunk began; characters stay whole."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.append((data & 0xC0) != 0x80, True)       # where a character may begin
    marks = np.flatnonzero((rolling(data) >> np.uint32(32 - BITS) == 0) & starts[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    end = 0
    for text in texts:
        begin, end, out = end, end + len(text), []
        last = begin
        for mark in [*marks[np.searchsorted(marks, begin + LEAST):np.searchsorted(marks, end)].tolist(), end]:
            while mark - last > GREATEST:
                cut = last + GREATEST
                while not starts[cut]:
                    cut -= 1
                out.append(text[last - begin:cut - begin])
                last = cut
            if mark - last >= LEAST or mark == end:
                if mark > last:
                    out.append(text[last - begin:mark - begin])
                last = mark
        yield out


class Words(dict):
    """Ids of words (runs without white space), as the library gives them for the word alone; they are remembered up to a number of bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        for gap in GAPS:
            if self._library(f"ab{gap}cd") != self._library("ab") + self._library("cd") or self._library(f"{gap}ab{gap}") != self._library("ab"):
                raise ValueError(f"{path}: pieces of this vocabulary can cross white space")
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        # Latin letters are one piece, lowered and with each byte as its character: tested here, the model alone gives their ids then.
        self.chars = byte_chars()
        self.plain = all(self._model(x.lower()) == self._library(x) for x in ("thequick", "Straße", "ÀÉÎÕÜ", "ŁÓDŹ"))
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, letters: str) -> list[int]:
        shown = letters if letters.isascii() else "".join(map(self.chars.__getitem__, letters.encode()))
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(".,;:!?")
            if self.plain and core.isalpha() and (core.isascii() or max(core) < "\u0250") and (low := core.lower()).isalpha():
                ids = array(self.code, self._model(low)).tobytes()
                if len(core) < len(word):
                    ids += self[word[len(core):]]
            else:
                ids = array(self.code, self._library(word)).tobytes()
        if len(word) <= 64:
            self.size += 200 + 2 * len(word) + len(ids)
            if self.size > MEMORY // 2:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    return Words(path)


@dataclass
class Run:
    """Encoded text: the word it begins in, the ids of its complete words and the word it ends in.

    Without a gap, ``head`` is all of it and ``tail`` is None. Words are in parts, as they came.
    """
    head: list[str]
    ids: list[bytes]
    tail: list[str] | None


def run_of(text: str, words: Words) -> Run:
    """A chunk by itself; its first and last word may go on in the neighbours."""
    if any(c in text for c in SEPARATORS):
        parts = _GAP.split(text)
    else:       # the same, faster
        parts = text.split()
        parts = ["", *parts] if text[:1].isspace() else parts
        parts = [*parts, ""] if text[-1:].isspace() else parts
    if len(parts) < 2:
        return Run([text], [], None)
    return Run([parts[0]], [b"".join(map(words.__getitem__, parts[1:-1]))], [parts[-1]])


def join(left: Run, right: Run, words: Words) -> Run:
    """Both runs as one. Where a word spans the join, its parts are encoded again as one; a word without an end yet waits for the next join."""
    if left.tail is None and right.tail is None:
        return Run(left.head + right.head, [], None)
    if left.tail is None:
        return Run(left.head + right.head, right.ids, right.tail)
    open_word = left.tail + right.head
    if right.tail is None:
        return Run(left.head, left.ids, open_word)
    return Run(left.head, [*left.ids, words["".join(open_word)], *right.ids], right.tail)


def finish(run: Run, words: Words) -> bytes:
    """Ids of a run that is a whole text."""
    return b"".join([words["".join(run.head)], *run.ids, words["".join(run.tail or [])]])


def _batches(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Batches with the chunks of their texts (null: none), about two megabytes of text at a time."""
    for batch in batches:
        size = pc.binary_length(batch.column(place)).fill_null(0).to_numpy()
        part = np.cumsum(size) // (2 << 20)
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for lo, hi in zip(bounds, bounds[1:]):
            some = batch.slice(lo, hi - lo)
            yield some, list(cuts([t or b"" for t in some.column(place).cast(pa.binary()).to_pylist()]))


def _hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


@dataclass
class Shared:
    """Which chunks may occur more than once (a filter of bits), and over how many tasks the commonest are dealt."""
    bits: np.ndarray
    hot: dict[int, int]

    def __contains__(self, h: int) -> bool:
        h &= 64 * len(self.bits) - 1
        return bool(int(self.bits[h >> 6]) >> (h & 63) & 1)


def shared_chunks(docs: DataFrame, text: str) -> Shared:
    """Chunks are counted by a 64-bit hash. A false member of the filter costs a detour; no shared chunk is missing from it."""
    def run(batches):
        for _, chunked in _batches(batches, 0):
            yield pa.RecordBatch.from_arrays([_signed([_hash(c) for chunks in chunked for c in chunks])], names=["h"])

    counts = materialise(docs.select(F.col(f"`{text}`")).mapInArrow(run, "h long").groupBy("h").count().where("count > 1"))
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    size = min(FILTER_BITS, max(64, 1 << (16 * n).bit_length()))
    words = (counts.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("slot"))
             .groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow())
    bits = np.zeros(size // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    hot = counts.where(F.col("count") * HOT > total).collect()
    return Shared(bits.view(np.uint64), {r["h"] & (1 << 64) - 1: min(1024, r["count"] * HOT // total + 1) for r in hot})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _grouped(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), types)] if rows else [pa.array([], f.type) for f in types], schema=types)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` of every row: the ids that the library's vocabulary at ``path`` gives the whole text, without special tokens being added.

    Null and empty texts, and those of white space alone, have no ids. Each row gives one row, repeated and null keys
    included; other columns are not looked at. ``docs`` is read three times and has to give its rows in the same order each
    time: a table as stored, or the result of ``materialise``; that every chunk arrived is checked. A text, its ids
    and a word may be as long as a cell holds.
    """
    own = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, text))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    made = f"row long, pos int, chunks int, key {kind}, head string, ids binary, tail string, open boolean"

    def local(batches):
        """A row per document with its number of chunks, and one per stretch of chunks that occur nowhere else."""
        words, shared, types = words_of(path), own.value, None
        for batch, chunked in _batches(batches, 2):
            types = types or pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("chunks", pa.int32()), ("key", batch.schema.field(1).type), ("head", pa.string()),
                                        ("ids", pa.binary()), ("tail", pa.string()), ("open", pa.bool_())])
            out = []
            for row, name, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), chunked):
                out.append((row, -1, len(chunks), name, None, None, None, None))
                first, made = 0, None
                for pos, chunk in enumerate(chunks):
                    if _hash(chunk) in shared:
                        out += [_packed(row, first, pos - first, made)] if made else []
                        made = None
                    elif made:
                        made = join(made, run_of(chunk.decode(), words), words)
                    else:
                        first, made = pos, run_of(chunk.decode(), words)
                out += [_packed(row, first, len(chunks) - first, made)] if made else []
            yield _grouped(out, types)

    def travelling(batches):
        """A row per occurrence of a shared chunk; a task sends the text of each once."""
        shared, sent = own.value, set()
        types = pa.schema([("digest", pa.binary()), ("salt", pa.int32()), ("row", pa.int64()), ("pos", pa.int32()), ("chunk", pa.string())])
        for batch, chunked in _batches(batches, 1):
            out = []
            for row, chunks in zip(batch.column(0).to_pylist(), chunked):
                for pos, chunk in enumerate(chunks):
                    if (h := _hash(chunk)) in shared:
                        known = (digest := xxhash.xxh3_128_digest(chunk), salt := row % shared.hot.get(h, 1))
                        out.append((digest, salt, row, pos, None if known in sent else chunk.decode()))
                        sent.add(known)
                        if len(sent) > 1 << 18:
                            sent.clear()
            yield _grouped(out, types)

    def once(batches):
        """Each chunk is encoded where it first stands; its other occurrences follow and take its ids."""
        words, last, of, made = words_of(path), None, None, None
        types = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("chunks", pa.int32()), ("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string()), ("open", pa.bool_())])
        for batch in batches:
            out = []
            for digest, row, pos, chunk in _rows([batch]):
                if digest != last:
                    if chunk is None:
                        raise RuntimeError("a shared chunk came without its text")
                    last, of, made = digest, chunk, run_of(chunk, words)
                elif chunk is not None and chunk != of:
                    raise RuntimeError("two chunks share a digest of 128 bits")
                packed = _packed(row, pos, 1, made)
                out.append(packed[:3] + packed[4:])
            yield _grouped(out, types)

    def assemble(batches):
        words, now, name, due, at, made = words_of(path), None, None, 0, 0, None
        names, sizes, flat = [], [], []

        def close():
            if now is not None:
                if at != due:
                    raise RuntimeError("rows came in another order when they were read again")
                ids = np.frombuffer(finish(made, words) if made else b"", words.code)
                names.append(name)
                sizes.append(len(ids))
                flat.append(ids)

        def give():
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.array((np.concatenate(flat) if flat else np.zeros(0)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(names, types), pa.ListArray.from_arrays(ends, ids)], names=["key", "ids"])

        types = None
        for batch in batches:
            types = types or batch.schema.field(3).type
            for row, pos, chunks, own_name, head, ids, tail, is_open in _rows([batch]):
                if row != now:
                    close()
                    now, name, due, at, made = row, own_name, chunks, 0, None
                    if sum(sizes) > 1 << 21:
                        yield give()
                        names, sizes, flat = [], [], []
                    if pos != -1:
                        raise RuntimeError("rows came in another order when they were read again")
                    continue
                part = Run([head], [ids] if ids else [], None if is_open else [tail])
                made = join(made, part, words) if made else part
                if pos != at:
                    raise RuntimeError("rows came in another order when they were read again")
                at += chunks
        close()
        if names:
            yield give()

    alone = source.mapInArrow(local, made)
    dealt = (source.select("row", "text").mapInArrow(travelling, "digest binary, salt int, row long, pos int, chunk string")
             .repartition("digest", "salt").sortWithinPartitions("digest", "salt", F.col("chunk").isNull()))
    met = (dealt.select("digest", "row", "pos", "chunk").mapInArrow(once, "row long, pos int, chunks int, head string, ids binary, tail string, open boolean")
           .withColumn("key", F.lit(None).cast(kind)))
    parts = alone.unionByName(met).repartition("row").sortWithinPartitions("row", "pos")
    return parts.mapInArrow(assemble, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def _packed(row: int, pos: int, chunks: int, run: Run) -> tuple:
    return row, pos, chunks, None, "".join(run.head), b"".join(run.ids), None if run.tail is None else "".join(run.tail), run.tail is None


def decode(df: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``df`` with the text of every row's ids, as the library decodes them with special tokens kept (null ids: none). A column of that name is replaced."""
    kept = [c for c in df.columns if c != column]
    where = kept.index(ids)
    source = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        tokenizer = Tokenizer.from_file(path)
        shown = pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))])
        for batch in batches:
            lists = batch.column(where)
            if tokenizer.decoder is None:       # tokens with blanks between
                tokens = shown.take(lists.flatten())
                sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), " ")
            else:
                out = pa.array([tokenizer.decode(x or [], skip_special_tokens=False) for x in lists.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*kept, column])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(column, StringType())]))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: encode every text, decode its ids, digest both."""
    both = decode(encode(docs, path, key, text), path)
    return both.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
