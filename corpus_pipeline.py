"""A training-corpus pipeline: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import language_id, packing, pu_quality, simhash_texts
from kbspark.llm.common import fold, stored, table
from kbspark.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; learned from the training fold's own languages."""
    pieces = tokenizer("piece_bpe_32k.model")
    model = language_id.learn(docs, pieces, fold(F.col("doc_id"), 4) != 2)
    return language_id.keep_identified(docs, model, pieces)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good."""
    network, _ = pu_quality.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return pu_quality.keep_good(docs, network)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest identifier, of each group of near-duplicates:
    texts whose five-word shingles have a Jaccard similarity of 0.8 or more, which SimHash fingerprints
    and Burkhard-Keller trees find and the texts confirm."""
    return simhash_texts.keep_first(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as best-fit packing finds."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", packed),
]

#: The stages learn models and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
