"""The registered queries of this subpackage: production parameters over the whole intended tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import align, bpe, decontaminate, html, jaccard, lines, neighbours, quality, secrets, substring, suffix, whiten, winnow
from tablewright.plans.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Place of the vocabulary and its pattern.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables."""

    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(*[spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in tables])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op2_byte_bpe", "documents")
def byte_bpe(documents: DataFrame) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents.select("doc_id", "text"), RANKS, PATTERN))


@query("op8_line_dedup", "documents", sql=lines.SQL)
def line_dedup(documents: DataFrame) -> DataFrame:
    return lines.query(documents)


@query("op3_decontaminate", "documents", "benchmark", sql=decontaminate.SQL)
def decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate.query(documents, benchmark)


@query("op6_secret_scan", "documents")
def secret_scan(documents: DataFrame) -> DataFrame:
    return secrets.query(documents)


@query("op1_ordinal_quality", "documents", "labels")
def ordinal_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.query(documents, labels)


@query("op7_block_anchors", "documents", sql=substring.SQL)
def block_anchors(documents: DataFrame) -> DataFrame:
    return substring.query(documents)


@query("op9_suffix_blocks", "documents")
def suffix_blocks(documents: DataFrame) -> DataFrame:
    return suffix.query(documents)


@query("op4_ngram_join", "documents", sql=jaccard.SQL)
def ngram_join(documents: DataFrame) -> DataFrame:
    return jaccard.query(documents)


@query("op10_nn_descent", "embeddings", sql=neighbours.SQL)
def nn_descent(embeddings: DataFrame) -> DataFrame:
    return neighbours.near_duplicates(embeddings)


@query("op5_host_paths", "pages")
def host_paths(pages: DataFrame) -> DataFrame:
    return html.query(pages)


@query("op11_whitening", "embeddings")
def whitening(embeddings: DataFrame) -> DataFrame:
    return whiten.query(embeddings)


@query("op12_winnowing", "documents")
def winnowing(documents: DataFrame) -> DataFrame:
    return winnow.query(documents)


@query("op13_token_alignment", "documents")
def token_alignment(documents: DataFrame) -> DataFrame:
    return align.query(documents, JSON, PIECES)
