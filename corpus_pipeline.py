"""From raw documents to training tokens: the stages in order, each over all rows that its predecessor kept.

Every stage takes the session, the documents and the folder of the other tables. All but the last return the columns
of the documents, whatever further ones there are; ``n_chars``, if there, follows the text. Documents without a text go through
as they are, also the quality classifier; empty tables give empty results.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, jaccard, lines, quality
from tablewright.plans.durable import durable
from tablewright.plans.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _counted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, with their number of characters."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose best grade is unlikely."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source, copies of a whole text counted once: they go in the next stage but for one."""
    ship(spark)
    return _counted(lines.drop_boilerplate(docs, copies=False), docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return jaccard.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages, and without the documents that are mostly such."""
    return _counted(decontaminate.remove(docs, _table(spark, sf_dir, "benchmark")), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.digests(tokens, "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]
#: A classifier fit and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
