"""From documents to a vector index, whole or just what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_hash
from ..operators import chunk, hybrid, incremental, route, vector
from ..sources import frontmatter


def kb_chunks(docs: DataFrame, embed: Callable[[Column], Column] = vector.hashed_embedding) -> DataFrame:
    """Chunks of knowledge-base documents (path, content): head parsed, cut at headings, short parts
    dropped, code numbered, embedded. ``embed`` maps a text column to a vector column."""
    parsed = frontmatter.parse(docs)
    parts = chunk.long_enough(chunk.sections(parsed, "path", "body"))
    rows = parts.join(parsed.select("path", "kb_layer", "summary"), "path")
    text = chunk.numbered(F.col("section"), F.col("start_line"))
    return rows.select("path", "heading", "kb_layer", "summary", route.source_type(F.col("path")).alias("source_type"), "start_line", F.substring(text, 1, chunk.STORE_CHARS).alias("text"), embed(F.substring(text, 1, chunk.EMBED_CHARS)).alias("vector"))


def reindex(index: DataFrame, manifest: DataFrame, docs: DataFrame, embed: Callable[[Column], Column] = vector.hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """The index and manifest (path, hash) after a run over all documents that embeds only those whose
    hash changed."""
    now = docs.select("path", file_hash(F.col("content")).alias("hash"))
    status = incremental.changes(manifest, now)
    todo = docs.join(status.filter(F.col("status").isin("added", "changed")).select("path"), "path", "left_semi")
    return incremental.upsert(index, kb_chunks(todo, embed), status), now


def hybrid_search(chunks: DataFrame, queries: DataFrame, symbols: DataFrame, edges: DataFrame, k: int = vector.TOP_K) -> DataFrame:
    """query_id, hits, graph_context for each query (query_id, query)."""
    found = vector.top_k_batch(chunks, queries, k, id_col="file_path", vector_col="vector").select("query_id", "rank", "file_path", "heading", "score")
    return hybrid.merged(found, hybrid.expand(found, symbols, edges))


def code_and_business(code: DataFrame, business: DataFrame, embed: Callable[[Column], Column] = vector.hashed_embedding) -> DataFrame:
    """One table of the chunks of both kinds of sources, told apart by ``collection``: source files cut at
    their headers, and documents of the business. code and business: path, content."""
    sides = [chunk.file_chunks(rows).withColumn("collection", F.lit(name)) for name, rows in (("code", code), ("business", business))]
    rows = sides[0].unionByName(sides[1])
    return rows.select("collection", "path", "source_type", "class_name", "method_name", "line_start", "line_end", F.substring("text", 1, chunk.STORE_CODE_CHARS).alias("text"), embed(F.substring("text", 1, chunk.EMBED_CHARS)).alias("vector"))
