"""Ordered computations over a key that may be arbitrarily large.

A plain ``Window.partitionBy(recording_id)`` puts a whole recording in one task. Here
each key is cut into blocks of its ordinal; windows run inside a block, one summary
row per block is carried across blocks, and the carry is joined back. The rows
themselves are shuffled once, on (key, block), however large one key is.

The input is read twice, the second time only for the columns a summary needs, so it
should be a scan or a written table: callers cut longer chains with ``materialise``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals per block.
BLOCK = 4096


def _packed(exprs: Mapping[str, Column]) -> Column:
    return F.struct(*[e.alias(n) for n, e in exprs.items()])


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
             block: Column | None = None,
             lag: Mapping[str, Column] | None = None,
             lag2: Mapping[str, Column] | None = None,
             lead: Mapping[str, Column] | None = None,
             sums: Mapping[str, Column] | None = None,
             last: Mapping[str, Column] | None = None,
             before: Mapping[str, Column] | None = None,
             islands: tuple[str, Mapping[str, Column], Callable[[Column, Column], Column]] | None = None,
             ) -> DataFrame:
    """Add columns over each key's rows in ``order``.

    ``lag``/``lag2``/``lead``: the expression one or two rows before, or one after;
    ``sums``: running sum including this row; ``last``/``before``: the latest non-null
    value up to, or strictly before, this row; ``islands``: ``(name, fields, opens)``
    numbers runs from 0, a new one where ``opens(previous fields, these fields)`` holds.
    ``block`` must not decrease along ``order``; by default it is the first order column
    cut in runs of ``BLOCK``.
    """
    lag, lag2, lead = dict(lag or {}), dict(lag2 or {}), lead or {}
    sums, last, before = sums or {}, last or {}, before or {}
    block = block if block is not None else F.floor(F.col(order[0]) / BLOCK)
    keyed = [*keys, "_blk"]
    at = F.struct(*order)
    rows = df.withColumn("_blk", block.cast("long"))
    inside = Window.partitionBy(*keyed).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    blocks_before = blocks.rowsBetween(Window.unboundedPreceding, -1)

    local: dict[str, Column] = {}      # columns added by windows inside a block
    summed: list[Column] = []          # one summary per block
    across: list[Column] = []          # summaries carried across blocks
    out: dict[str, Column] = {}
    base = rows

    if lag:
        local["_lag"] = F.lag(_packed(lag)).over(inside)
        summed.append(F.max_by(_packed(lag), at).alias("_t1"))
        across.append(F.lag("_t1").over(blocks).alias("_c_lag"))
        out |= {n: F.coalesce("_lag", "_c_lag")[n] for n in lag}
    if lag2:
        base = base.withColumn("_rest", F.when(F.lead(F.lit(1), 1).over(inside).isNull(), 0).when(
            F.lead(F.lit(1), 2).over(inside).isNull(), 1))
        local["_lag2"] = F.lag(_packed(lag2), 2).over(inside)
        local["_row"] = F.row_number().over(inside)
        summed += [F.max_by(_packed(lag2), F.when(F.col("_rest") == 0, at)).alias("_u1"),
                   F.max_by(_packed(lag2), F.when(F.col("_rest") == 1, at)).alias("_u2")]
        second = F.coalesce(F.lag("_u2").over(blocks), F.lag("_u1", 2).over(blocks))
        across += [F.lag("_u1").over(blocks).alias("_c_u1"), second.alias("_c_u2")]
        out |= {n: F.coalesce("_lag2", F.when(F.col("_row") == 2, F.col("_c_u1")).otherwise(F.col("_c_u2")))[n]
                for n in lag2}
    if lead:
        local["_lead"] = F.lead(_packed(lead)).over(inside)
        summed.append(F.min_by(_packed(lead), at).alias("_h1"))
        across.append(F.lead("_h1").over(blocks).alias("_c_lead"))
        out |= {n: F.coalesce("_lead", "_c_lead")[n] for n in lead}
    for n, e in sums.items():
        local[f"_s_{n}"] = F.coalesce(F.sum(e).over(upto), F.lit(0))
        summed.append(F.sum(e).alias(f"_s_{n}"))
        across.append(F.coalesce(F.sum(f"_s_{n}").over(blocks_before), F.lit(0)).alias(f"_c_s_{n}"))
        out[n] = F.col(f"_s_{n}") + F.col(f"_c_s_{n}")
    for frame, wanted in (("f", last), ("g", before)):
        for n, e in wanted.items():
            local[f"_{frame}_{n}"] = F.last(e, ignorenulls=True).over(upto if frame == "f" else earlier)
            summed.append(F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_{frame}_{n}"))
            across.append(F.last(f"_{frame}_{n}", ignorenulls=True).over(blocks_before).alias(f"_c_{frame}_{n}"))
            out[n] = F.coalesce(f"_{frame}_{n}", f"_c_{frame}_{n}")
    if islands:
        name, fields, opens = islands
        # Inside a block every row but the first knows its predecessor; whether the first
        # one opens a run is decided where the block's summary meets the one before.
        base = base.withColumn("_i_me", _packed(fields)).withColumn("_i_prev", F.lag("_i_me").over(inside))
        inner = F.when(F.col("_i_prev").isNotNull(), opens(F.col("_i_prev"), F.col("_i_me")).cast("int")).otherwise(0)
        base = base.withColumn("_i_open", inner)
        local["_i_run"] = F.sum("_i_open").over(upto)
        summed += [F.sum("_i_open").alias("_i_n"), F.min_by("_i_me", at).alias("_i_head"),
                   F.max_by("_i_me", at).alias("_i_tail")]
        met = F.lag("_i_tail").over(blocks)
        first = F.when(met.isNull(), 0).otherwise(opens(met, F.col("_i_head")).cast("int"))
        across += [first.alias("_i_first"), F.col("_i_n")]

    carry = base.groupBy(*keyed).agg(*summed).select(*keyed, *across)
    if islands:
        carry = carry.withColumn("_c_i", F.sum(F.col("_i_first") + F.col("_i_n")).over(blocks)
                                 - F.col("_i_n")).drop("_i_first", "_i_n")
        out[name] = F.col("_i_run") + F.col("_c_i")
    joined = base.withColumns(local).join(carry, keyed, "left")
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[e.alias(n) for n, e in out.items()])


def dense(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *,
          block: Column | None = None) -> DataFrame:
    """Number each key's rows 0, 1, 2 … in ``order``."""
    out = in_order(df, keys, order, block=block, sums={name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - 1).cast("long"))
