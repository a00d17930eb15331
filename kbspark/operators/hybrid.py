"""Vector hits with the graph around the symbols of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cap


def expand(hits: DataFrame, symbols: DataFrame, edges: DataFrame, method_cap: int = 8) -> DataFrame:
    """Rows of graph context: query_id, file_path, symbol, edge_type, neighbour. One join takes the
    place of a call for each hit and symbol. hits: query_id, file_path; symbols: file_path, symbol;
    edges: src, edge_type, dst, place."""
    asked = hits.select("query_id", "file_path").distinct().join(symbols.select("file_path", "symbol"), "file_path")
    own = asked.select("symbol").distinct()
    around = edges.select(F.col("src").alias("symbol"), "edge_type", F.col("dst").alias("neighbour"), "place").join(own, "symbol", "left_semi")
    return asked.join(cap(around, method_cap).drop("place"), "symbol").select("query_id", "file_path", "symbol", "edge_type", "neighbour")


def merged(hits: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, hits (in their order, never ranked anew), graph_context (a group for each hit that has
    any). hits: query_id, rank, file_path, heading, score."""
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file_path", "heading", "score"))).alias("hits"))
    groups = context.groupBy("query_id", "file_path").agg(F.sort_array(F.collect_set(F.struct("symbol", "edge_type", "neighbour"))).alias("expansions"))
    told = groups.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("file_path", "expansions"))).alias("graph_context"))
    empty = F.array().cast(told.schema["graph_context"].dataType)
    return found.join(told, "query_id", "left").withColumn("graph_context", F.coalesce("graph_context", empty))


def cleaned(hits: DataFrame) -> DataFrame:
    """Only the fields that a hit shows; empty strings become null."""
    shown = ["score", "file_path", "heading", "line_start", "line_end", "class_name", "method_name", "module", "source_type", "collection", "snippet", "author"]
    kinds = dict(hits.dtypes)
    return hits.select(*(c for c in ("query_id", "rank") if c in kinds), *(F.nullif(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in shown if c in kinds))
