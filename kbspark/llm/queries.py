"""The registered queries of the training-data operators: thin wrappers that bind each operator to
its whole table with production parameters and derive the contract's columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, divergence, importance, language_id, ngram_lm, packing, pu_quality, quality_rules, simhash, sstable, token_rollup, toxicity, trie_bpe
from .common import fold, held_out, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer file is: the folder that KBSPARK_TOKENIZERS names, or the
    installed package."""
    folder = os.environ.get("KBSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network, _ = pu_quality.learn(docs, labels, fold(F.col("doc_id"), 3) != 1)
    found = pu_quality.score(docs, network)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return sstable.read_shards(manifest)


def op3_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")
    model = language_id.learn(docs, pieces, fold(F.col("doc_id"), 4) != 2)
    found = language_id.identify(docs, model, pieces)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048, cache_entries=1_200_000)


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op7_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.learn(docs, fold(F.col("doc_id"), 7) != 2)
    found = ngram_lm.score(docs, model)
    return found.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(table(spark, sf_dir, "documents"))


def token_rollup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with versions that are tokenizer files."""
    versions = ("word_bpe_49k", "byte_bpe_50k")
    return token_rollup.by_tokenizer(table(spark, sf_dir, "documents"), {v: tokenizer(f"{v}.json") for v in versions})


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.neighbours(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_zstd_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.learn(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, found)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu": op1_nnpu,
    "op2_sstable": op2_sstable,
    "op3_piece_unigrams": op3_piece_unigrams,
    "op4_best_fit": op4_best_fit,
    "op5_trie_bpe": op5_trie_bpe,
    "op6_simhash_bktree": op6_simhash_bktree,
    "op7_risk_rules": op7_risk_rules,
    "op8_elias_fano_lm": op8_elias_fano_lm,
    "op9_token_rollup": op9_token_rollup,
    "op10_cover_tree": op10_cover_tree,
    "op11_heavy_light": op11_heavy_light,
    "op12_overlap_chunks": op12_overlap_chunks,
    "op13_zstd_distance": op13_zstd_distance,
    "token_rollup_files": token_rollup_files,
}

ORACLE_SQL: dict[str, str] = {
    "op7_risk_rules": quality_rules.oracle(),
    "op9_token_rollup": token_rollup.ORACLE,
    "op10_cover_tree": cover_tree.ORACLE,
    "op11_heavy_light": divergence.ORACLE,
    "op12_overlap_chunks": importance.ORACLE,
}
