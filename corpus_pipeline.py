"""From raw documents to encoded training data, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.llm import exact, mixing, queries, simhash, toxicity, word_bpe
from shelfmark.llm.rows import ship_package
from shelfmark.session import apply_settings

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text in a block of the encoder: this stage runs in executors that the stages before it have filled.
BLOCK_BYTES = 6_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the folder."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that are equal without white space stays."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights, one row for each epoch that takes them."""
    added = ("_mix_domain", "_mix_tokens", "_mix_copies")
    chosen = mixing.mix(
        docs, queries.target_weights(spark), F.expr(queries.DOMAIN), queries.BUDGET_PERCENT, added=added)
    return chosen.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the text they decode to."""
    ship_package(spark)
    return word_bpe.encode(docs, public_tokenizers.path(TOKENIZER), block_bytes=BLOCK_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("word_bpe", encode),
]

#: SQL cannot express the classifier, the fingerprints and the encoder; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each on the stored result of the one before."""
    apply_settings(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
