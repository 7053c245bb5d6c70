"""Where somebody else's language model is called.

A client is opened once per partition, rows stream through it in Arrow batches, and a
cache (``catalogue.reuse_passes``) stands in front of the expensive ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colloquy.operators.catalogue import PASS_KEY, reuse_passes


def map_text(prompts: DataFrame, open_client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``answer`` for each ``text``: ``open_client()`` gives the function that asks."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = open_client()
        for pdf in batches:
            yield pdf.assign(answer=[client(t) for t in pdf["text"]])
    return prompts.mapInPandas(ask, schema)


def ask_cached(chunks: DataFrame, cache: DataFrame, open_client) -> tuple[DataFrame, DataFrame]:
    """``(answers, fresh)``: every chunk with its answer, and the rows to append to the cache.

    Chunks carry the ``PASS_KEY`` columns; those answered before are not asked again.
    """
    from colloquy.plans.store import materialise
    hits, misses = reuse_passes(chunks, cache)
    fresh = materialise(map_text(misses, open_client))      # asked once, read twice
    return hits.unionByName(fresh.select(*hits.columns)), fresh.select("pass_key", "answer")


__all__ = ["PASS_KEY", "ask_cached", "map_text"]
