"""Sequential state machines over ordered rows, run block by block.

Some rules restart from their own last decision ("a new paragraph once this one is
full"). Each key's rows are cut into blocks; every block is folded from a guessed entry
state, and blocks whose entry turns out different from their predecessor's exit are
folded again until nothing changes. Such rules forget their start after a few decisions,
so one or two rounds settle any length; no task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.plans.store import materialise

#: Rows per block: far more than such a rule remembers, small enough for one task.
BLOCK_ROWS = 16384
#: Rows handed to a task at once: many short keys, or a few blocks of long ones.
BUCKET_ROWS = 65536

Fold = Callable[[pd.DataFrame, list[float]], tuple[pd.DataFrame | dict, list[float]]]


def fold_blocks(df: DataFrame, keys: Sequence[str], ordinal: str, fold: Fold,
                out: T.StructType, zero: Sequence[float], *, lookahead: int = 0,
                block_rows: int = BLOCK_ROWS, reads: Sequence[str] | None = None) -> DataFrame:
    """``fold(rows, state) -> (rows out, state)`` over each key in ``ordinal`` order.

    ``ordinal`` must be dense from 0. ``rows`` of a block come sorted, with up to
    ``lookahead`` rows of the next block marked ``_ahead``. ``out`` lists the columns
    the fold returns; the keys are among them. Instead of rows a fold may return a dict of
    arrays: all of these columns, or new ones alone with a value for each row of the block.

    ``reads``: the columns the fold looks at (all, if not given); the others stay out of pandas.

    A task is handed some ``BUCKET_ROWS`` rows at a time, so that many short keys share a call.
    """
    keys = list(keys)
    start = F.array(*[F.lit(float(z)) for z in zero])
    rows = df.withColumn("_blk", F.floor(F.col(ordinal) / block_rows).cast("long"))
    if lookahead:
        near = (F.col(ordinal) % block_rows < lookahead) & (F.col("_blk") > 0)
        copies = F.when(near, F.array(
            F.struct(F.col("_blk").alias("b"), F.lit(False).alias("a")),
            F.struct((F.col("_blk") - 1).alias("b"), F.lit(True).alias("a")),
        )).otherwise(F.array(F.struct(F.col("_blk").alias("b"), F.lit(False).alias("a"))))
        rows = (rows.withColumn("_c", F.explode(copies))
                .withColumns({"_blk": F.col("_c.b"), "_ahead": F.col("_c.a")}).drop("_c"))
    else:
        rows = rows.withColumn("_ahead", F.lit(False))

    grouped = [*keys, "_blk"]
    shape = to_arrow_schema(out)

    def blocks(table: pa.Table):
        """The bucket's rows in order and, block by block, where it starts and what the fold makes of it."""
        seen = table.select([c for c in table.column_names if reads is None or c in (*grouped, ordinal, "_ahead", "_entry", *reads)]).to_pandas()
        group = seen.groupby(grouped, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((seen[ordinal].to_numpy(), group))
        seen, group = seen.take(order).reset_index(drop=True), group[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        entries = [list(e) for e in seen["_entry"].iloc[starts]] if "_entry" in seen.columns else [list(zero)] * len(starts)
        made = [fold(seen.iloc[a:b].reset_index(drop=True), list(e)) for a, b, e in zip(starts, np.append(starts[1:], len(seen)), entries, strict=True)]
        return table.take(pa.array(order)), starts, made

    def emit(table: pa.Table) -> pa.Table:
        table, _, made = blocks(table)
        made = [m for m, _ in made]
        if not isinstance(made[0], dict):
            return pa.Table.from_pandas(pd.concat(made, ignore_index=True)[shape.names], shape, preserve_index=False)
        new = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
        own = table.filter(pc.invert(table["_ahead"]))
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else own[f.name].cast(f.type) for f in shape], schema=shape)

    def leave(table: pa.Table) -> pa.Table:
        table, starts, made = blocks(table)
        exits = pa.array([[float(x) for x in exit_] for _, exit_ in made], pa.list_(pa.float64()))
        return table.select(grouped).take(pa.array(starts)).append_column("_exit", exits)

    furthest, many = df.agg(F.max(ordinal), F.count(F.lit(1))).first()
    buckets = -(-many // BUCKET_ROWS) or 1
    # Rows without a key stay by themselves: they would make numbers of the others' keys.
    keyless = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    rows = rows.withColumn("_bucket", F.when(keyless, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*grouped), F.lit(buckets))))
    if furthest is None or furthest < block_rows:
        return rows.groupBy("_bucket").applyInArrow(emit, out)

    rows = materialise(rows)
    exit_schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("_blk", T.LongType()),
        T.StructField("_exit", T.ArrayType(T.DoubleType()))])
    state = materialise(rows.withColumn("_entry", start).groupBy("_bucket")
                        .applyInArrow(leave, exit_schema).withColumn("_entry", start))
    while True:
        due = F.coalesce(F.lag("_exit").over(Window.partitionBy(*keys).orderBy("_blk")), start)
        moved = materialise(state.withColumn("_due", due).where(F.col("_due") != F.col("_entry"))
                            .select(*grouped, F.col("_due").alias("_entry")))
        if moved.isEmpty():
            break
        redone = (rows.join(moved, grouped).groupBy("_bucket").applyInArrow(leave, exit_schema)
                  .join(moved, grouped).select(*state.columns))
        state = materialise(state.join(moved, grouped, "left_anti").unionByName(redone))
    return rows.join(state.select(*grouped, "_entry"), grouped).groupBy("_bucket").applyInArrow(emit, out)
