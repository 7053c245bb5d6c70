"""Vector codes: four codebooks of 256 integer entries, assigned through an integer Walsh-Hadamard transform.

Components become integers, vectors are cut into equal parts, and each part is coded by its nearest entry. Parts and
entries are padded with zeros to a power of two and transformed by additions alone. The transform of length P
multiplies squared distances by exactly P, so squared differences are added up in sequency order (fewest sign changes first)
and an entry is out as soon as its sum is above the scaled distance of an entry already measured in full. All of it is
integer arithmetic: sums only grow, so no entry that could be nearest or tie is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import maybe_broadcast
from colloquy.plans.store import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with all entries at a time.
BLOCK = 1024


def sequency_order(length: int) -> np.ndarray:
    """Places of the Sylvester-ordered transform by rising number of sign changes; ``length`` is a power of two."""
    at = np.arange(length)
    gray, order = at ^ (at >> 1), np.zeros(length, np.int64)
    for _ in range(length.bit_length() - 1):
        order, gray = (order << 1) | (gray & 1), gray >> 1
    return order


def transform(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of integer rows, zero-padded to a power of two, in sequency order."""
    n, width = rows.shape
    length = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((n, length), np.int64)
    out[:, :width] = rows
    half = 1
    while half < length:
        pair = out.reshape(n, length // (2 * half), 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, length)
        half *= 2
    return out[:, sequency_order(length)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, squared distance)`` of the nearest entry for each row of transformed parts; ties go to the lower index."""
    index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    length = rows.shape[1]
    for lo in range(0, len(rows), BLOCK):
        x = rows[lo:lo + BLOCK]
        first = max(1, length // 4)
        sums = np.zeros((len(x), len(entries)), np.int64)
        for c in range(first):
            off = x[:, c, None] - entries[None, :, c]
            sums += off * off
        # One entry a row is measured in full: the best so far. What is already farther is out.
        guess = sums.argmin(axis=1)
        bound = ((x - entries[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left, c = sums[row, entry], first
        while c < length:
            upto = min(length, c + max(1, length // 8))
            for k in range(c, upto):
                off = x[row, k] - entries[entry, k]
                left += off * off
            stay = left <= bound[row]
            row, entry, left, c = row[stay], entry[stay], left[stay], upto
        # Pairs stand by row and entry, and each row still has its guess at least.
        start = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(left, start) if len(x) else left
        tie = np.flatnonzero(left == least[row])
        at = tie[np.searchsorted(row[tie], np.arange(len(x)))]
        index[lo:lo + BLOCK], error[lo:lo + BLOCK] = entry[at], left[at] // length
    return index, error


def whole(embedding: Column) -> Column:
    """Whether a vector is not null and all its components are finite; zeros and empty vectors are fine."""
    fine = F.forall(embedding.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(embedding.isNotNull() & fine, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an integer list column as a matrix; shorter rows are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _books(seeds: list[list[int]], width: int) -> np.ndarray:
    """Codebooks ``[part, entry, position]`` that start as the parts of the given vectors."""
    rows = np.zeros((len(seeds), width), np.int64)
    for row, seed in zip(rows, seeds):
        row[:len(seed)] = seed
    return rows.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def _sums(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """``(slot, n, s0, s1, ...)``: how many parts each entry got and their sums by component, added up in each task first."""
    parts, entries, width = books.shape
    names = ["slot", "n", *(f"s{i}" for i in range(width))]

    def run(batches):
        moved = [transform(book) for book in books]
        count, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                slot = nearest(transform(rows[:, p]), moved[p])[0] + p * entries
                np.add.at(count, slot, 1)
                np.add.at(sums, slot, rows[:, p])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(sums[used, i]) for i in range(width))], names=names)

    partial = ints.select("z").mapInArrow(run, ", ".join(f"{name} long" for name in names))
    return partial.groupBy("slot").agg(*[F.sum(name).alias(name) for name in names[1:]])


def train(ints: DataFrame, key: str, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks for ``ints(key, z)``. Of 256 vectors at most come the first entries, and only the entries' sums reach the driver."""
    seeds = ints.orderBy(F.col(key).asc_nulls_last(), "z").limit(ENTRIES).select("z").collect()
    books = _books([list(r["z"]) for r in seeds], width)
    for _ in range(rounds):
        for got in _sums(ints, books).collect():
            p, e = divmod(got["slot"], books.shape[1])
            books[p, e] = [got[f"s{i}"] // got["n"] for i in range(books.shape[2])]
    return books


def assign(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """``ints`` with ``code`` (two hex digits a part) and ``error`` (squared distances of all parts) in place of ``z``."""
    parts, _, width = books.shape
    kept = [c for c in ints.columns if c != "z"]
    schema = ints.select(*kept).schema.add("code", "string").add("error", "long")

    def run(batches):
        moved = [transform(book) for book in books]
        for batch in batches:
            rows = _matrix(batch.column(len(kept)), parts * width).reshape(-1, parts, width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                codes[:, p], off = nearest(transform(rows[:, p]), moved[p])
                error += off
            digits = codes.tobytes().hex()
            shown = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(shown, pa.string()), pa.array(error)], names=[*kept, "code", "error"])

    return ints.select(*kept, "z").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(key, label, code, error)`` of every vector, and the codebooks ``[part, entry, position]``.

    Rows with a null vector or with null or non-finite components are left out; zero vectors are kept. Vectors shorter
    than the longest (rounded up to a multiple of four) count as filled up with zeros. Fewer than 256 rows give so many
    entries; equal and repeated rows each give an entry, and the lower one wins. Null keys come last among the first
    entries, equal keys in the order of their vectors. An empty table gives no rows and empty codebooks. Components so
    large that a squared distance would leave 64 bits are refused with an error.
    """
    ints = materialise(vectors.where(whole(F.col(f"`{embedding}`"))).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"),
        F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: F.floor(x * SCALE)).alias("z")))
    longest, top = ints.agg(F.max(F.size("z")), F.max(F.greatest(F.abs(F.array_max("z")), F.abs(F.array_min("z"))))).first()
    width = -(-max(longest or 0, 1) // PARTS) * PARTS
    if 4 * (top or 0) ** 2 * width * (1 << (width // PARTS - 1).bit_length()) >= 1 << 63:
        raise ValueError(f"components of up to {top / SCALE} are too large for exact 64-bit distances")
    books = train(ints, "key", width, rounds)
    if books.shape[1] == 0:
        return ints.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    return assign(ints, books), books


def code_table(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``; ``label_error`` is the error summed over equal labels, nulls together."""
    made, books = compress(vectors, rounds=rounds)
    made = materialise(made)
    sums = materialise(made.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")))
    joined = made.join(maybe_broadcast(sums), F.col("label").eqNullSafe(F.col("own")))
    return joined.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
