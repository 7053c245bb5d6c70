"""A function of one recording's rows, run where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def in_place(rows: DataFrame, order: Sequence[str], one: Callable[[pa.Table], pa.Table], out: T.StructType) -> DataFrame:
    """``one(rows of a recording in order) -> rows out``, both Arrow tables.

    Rows that are partitioned by recording already are not shuffled. A recording has to fit a task; rows without one are left out.
    """
    shape = to_arrow_schema(out)

    def made(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        starts = np.flatnonzero(table["_first"].to_numpy())
        found = [one(table.slice(a, b - a)).cast(shape) for a, b in zip(starts, np.append(starts[1:], len(table)), strict=True)]
        yield from pa.concat_tables(found).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                yield from made([*held, batch.slice(0, starts[-1])])
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from made(held)

    first = F.row_number().over(Window.partitionBy("recording_id").orderBy(*order)) == 1
    return rows.where("recording_id is not null").withColumn("_first", first).mapInArrow(run, out)
