"""What the vector operators share: valid vectors, exact copies as one, shards of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards at least (so that a small table is spread too), and vectors a shard holds at most.
SHARDS, SHARD_ROWS = 8, 1 << 18


def sound(embedding: Column) -> Column:
    """Whether a vector can have a cosine: not null, not zero, all components finite."""
    v = embedding.cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def valid(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows with a sound vector."""
    return vectors.where(sound(F.col(embedding))).select(F.col(key).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))


def shards_for(rows: int, most: int = SHARD_ROWS, least: int = SHARDS) -> int:
    return max(least, -(-rows // most))
