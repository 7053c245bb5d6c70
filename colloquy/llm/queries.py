"""The training-data operators as queries over the given tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import chunks, codes, hnsw, huffman, lexical, minhash, oracles, packing, permutation, ring, surrogates, tokens, toxicity, warc
from colloquy.llm.common import table
from colloquy.plans.store import materialise, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        if (sql := getattr(oracles, name.upper(), None)) is not None:
            ORACLES[name] = sql
        return fn
    return register


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("op7_ring_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_warc_transactions")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # The archives are parsed once; only headers and lengths of the records are kept for the joins.
    records = materialise(warc.read(spark, path, payloads=False))
    return warc.page_table(warc.assemble(records)).drop("url")


@query("op2_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, "text", count="n_replaced")


@query("op4_huffman_ids")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.store(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


@query("op6_byte_level_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@query("op5_bottom_k_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op1_factorization_machine")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_permutation_index")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"))


@query("op3_hnsw_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_bag_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_chunked_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op13_hadamard_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_table(table(spark, sf_dir, "embeddings"))
