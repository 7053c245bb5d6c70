"""From raw documents to packed training sequences, in four stages.

Every stage reads what the one before wrote, and each decision takes effect: toxic documents go, one document
of each group of near duplicates stays, personal data is replaced, and what is left is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import minhash, packing, surrogates, toxicity
from colloquy.llm.common import table
from colloquy.plans.store import shared_dir

#: Documents that score this much are toxic.
TOXIC = 0.3
#: Shared shingles, in percent, from which two documents are near duplicates.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below ``TOXIC``; null and blank texts stay."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    clean = (F.col("toxicity__") < TOXIC) | (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    return toxicity.score(docs, machine, column="toxicity__").where(clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id. Of rows repeated with id and text one
    stays. Rows without an id stay only where no near duplicate has one; texts without words all stay."""
    return minhash.deduplicate(docs, percent=SIMILAR)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for personal data; ``n_chars`` follows a changed text."""
    out = surrogates.pseudonymise(docs, "text", count="replaced__")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("replaced__") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document with its bin and offset."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("personal data", replace_personal_data), ("packing", pack)]
#: A trained score, keyed surrogates and best fit are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
