"""Exact cosine search over stored vectors.

A search never shuffles the vectors: each task scores its rows and keeps its best k
(``TakeOrderedAndProject``, or a ``WindowGroupLimit`` per query), and only these meet. Ties are
broken by similarity before rounding, then by identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.vectors import cosine, score
from ..sources.tables import working_folder

TOP_K, THRESHOLD, CROSS_PROJECT_K = 5, 0.35, 10
#: Queries of a block, and bytes of vectors that a task holds while it compares them with one block after the other.
QUERY_BLOCK, GATHERED = 1 << 12, 16 << 20
#: Similarities that a task computes at a time, and rows of hits that it hands on at a time.
PAIRS, HANDED = 1 << 20, 1 << 12


def top_k(chunks: DataFrame, query: list[float], k: int = TOP_K, threshold: float | None = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows and their scores; the threshold holds for the rounded score and applies
    after the cut to k. Rows whose vector is null, zero or of another length are no hits."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.withColumn("similarity", F.when(F.size(vector_col) == len(query), cosine(F.col(vector_col), asked)))
    found = scored.filter("similarity is not null").withColumn("score", score(F.col("similarity")))
    best = found.orderBy(F.desc("score"), F.desc("similarity"), F.asc(id_col)).limit(k)
    return best.filter(F.col("score") >= threshold) if threshold is not None else best


def top_k_batch(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, threshold: float | None = THRESHOLD, by: list[str] | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row (query_id, query, and what else comes along) the k nearest rows (of each group
    ``by``), with their rank.

    The queries are written once, in files of at most ``QUERY_BLOCK``, to the folder that all executors share; the driver
    holds none of them. A task reads its vectors once, some at a time, and compares these with one block of
    queries after the other by matrix products; it keeps the best k of each query, and only these are
    shuffled. The products only pick candidates: a candidate's similarity is summed in the order of the
    components. Vectors that are null, zero, of another length or that hold a null or non-finite component
    are no hits.
    """
    keys = ["query_id", *(by or [])]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("similarity"), F.asc(id_col))
    schema = StructType(list(chunks.schema.fields)).add(queries.schema["query_id"]).add("similarity", "double")
    blocks = _written(queries.select("query_id", F.col("query").cast("array<double>").alias("query")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches):
            for path in blocks:
                yield from _nearest(_opened(path), k, by or [], id_col, vector_col)(iter(some))

    found = chunks.mapInArrow(run, schema)
    out = found.withColumn("score", score(F.col("similarity"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if len(queries.columns) > 2:
        out = out.join(queries.drop("query"), "query_id")
    return out.filter(F.col("score") >= threshold) if threshold is not None else out


def _written(queries: DataFrame) -> list[str]:
    """Files of the shared folder that hold a block of queries each."""
    spark, folder = queries.sparkSession, working_folder(queries.sparkSession)
    queries.coalesce(8).write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f"{folder}/{name}" for x in found if (name := x.getPath().getName()).endswith(".parquet"))


def _opened(path: str) -> pa.Table:
    """A block of queries; the last one stays in memory, which is all where there is only one."""
    if path not in _BLOCK:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as source:
            table = pq.ParquetFile(source).read(use_threads=False)
        _BLOCK.clear()
        _BLOCK[path] = table
    return _BLOCK[path]


_BLOCK: dict[str, pa.Table] = {}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of a task, ``GATHERED`` bytes of them at a time, so that blocks of queries are opened seldom."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matrix(column: pa.Array, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors at these places those that can be compared: place, components, square of the length."""
    rows = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)
    with np.errstate(all="ignore"):
        square = np.cumsum(rows * rows, axis=1)[:, -1]
    good = np.isfinite(rows).all(axis=1) & (square > 0)
    return at[good], rows[good], square[good]


def _members(rows: pa.Table, by: list[str], at: np.ndarray) -> list[np.ndarray]:
    """These places, those of each group for themselves."""
    group = np.zeros(len(rows), np.int64)
    for c in by:
        code = pc.fill_null(rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False)
        group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    at = at[np.argsort(group[at], kind="stable")]
    return [x for x in np.split(at, np.flatnonzero(np.diff(group[at])) + 1) if len(x)]


def _nearest(asked: pa.Table, k: int, by: list[str], id_col: str, vector_col: str):
    """What a task does for a block of queries. Of hits it holds row numbers and similarities only, it compares ``PAIRS`` pairs
    at a time, and it hands the rows on in small batches: its memory grows neither with the queries nor with the vectors."""
    queries = asked["query"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(queries), 0).to_numpy(zero_copy_only=False)

    def run(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        vectors = rows[vector_col].combine_chunks()
        length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        place = np.empty(len(rows), np.int64)
        place[pc.sort_indices(rows, sort_keys=[(id_col, "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(rows))
        for size in (int(s) for s in np.unique(sizes[sizes > 0])):
            groups, own = _members(rows, by, np.flatnonzero(length == size)), np.flatnonzero(sizes == size)
            width = max(1, PAIRS // max(8 * k, size))
            for low in range(0, len(own), width):
                which, wanted, square = _matrix(queries, own[low : low + width], size)
                for at in groups if len(which) else ():
                    q, row, similarity = _best(vectors, at, place, wanted, square, k)
                    for i in range(0, len(q), HANDED):
                        picked = rows.take(pa.array(row[i : i + HANDED]))
                        picked = picked.append_column("query_id", asked["query_id"].take(pa.array(which[q[i : i + HANDED]])))
                        yield from picked.append_column("similarity", pa.array(similarity[i : i + HANDED], pa.float64())).to_batches()

    return run


def _best(vectors: pa.Array, at: np.ndarray, place: np.ndarray, wanted: np.ndarray, square: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and similarity of the best k of these rows for each query; place: the rows' order among equals. A row that is
    further off than k others so far is dropped at once."""
    size = wanted.shape[1]
    unit, floor = wanted / np.sqrt(square)[:, None], np.full(len(wanted), -np.inf)
    held, many, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, max(k, PAIRS // max(len(wanted), size))

    def cut() -> None:
        q, row, similarity = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place[row], -similarity, q))
        q, row, similarity = q[order], row[order], similarity[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        held[:] = [(q[nth < k], row[nth < k], similarity[nth < k])]
        floor[q[nth == k - 1]] = similarity[nth == k - 1]

    for low in range(0, len(at), step):
        some, own, norm = _matrix(vectors, at[low : low + step], size)
        if not len(some):
            continue
        near = unit @ (own / np.sqrt(norm)[:, None]).T
        found = near >= floor[:, None] - 1e-9
        with np.errstate(all="ignore"):  # beyond this the products tell nothing of the similarities, and may not pick
            plain = norm.min() * square.min() > 1e-290 and norm.max() * square.max() < np.inf
        if plain and len(some) > k and np.count_nonzero(found) > 2 * k * len(wanted):
            found &= near >= np.partition(near, len(some) - k, axis=1)[:, len(some) - k, None] - 1e-9
        q, i = np.nonzero(found)
        part = max(1, PAIRS // size)
        for first in range(0, len(q), part):
            a, b = q[first : first + part], i[first : first + part]
            with np.errstate(all="ignore"):
                exact = np.cumsum(own[b] * wanted[a], axis=1)[:, -1] / np.sqrt(norm[b] * square[a])
            good = np.isfinite(exact) & (exact >= floor[a])
            held.append((a[good], some[b[good]], exact[good]))
            many += np.count_nonzero(good)
            if many >= k * len(wanted):
                cut()
                many = 0
    cut()
    return held[0]


def merge_collections(hits: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, id_col: str = "vec_id") -> DataFrame:
    """Best k over collections of hits that each collection's search has found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), F.asc(id_col))
    kept = hits.filter(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order))
    return kept.filter(F.col("rank") <= k)


def choose_collections(known: list[str], kind: str | None = None) -> list[str]:
    """The collection asked for; else the document collection; else the known ones of the older
    layout; else all."""
    if kind and kind in known:
        return [kind]
    if "kb" in known:
        return ["kb"]
    return [c for c in ("code", "business") if c in known] or list(known)


def merge_projects(by_project: dict[str, DataFrame], k: int = CROSS_PROJECT_K, id_col: str = "vec_id") -> DataFrame:
    """Hits of several projects' searches (columns similarity and score) as one list, no threshold."""
    out = None
    for project, hits in by_project.items():
        named = hits.withColumn("project", F.lit(project))
        out = named if out is None else out.unionByName(named)
    return out.orderBy(F.desc("score"), F.desc("similarity"), F.asc(id_col), F.asc("project")).limit(k)


def needs_rebuild(stored: dict, model: str, dimensions: int, fields: list[str], table_fields: list[str]) -> bool:
    """Whether an index must be built anew: another model, another dimension, or a new field."""
    return stored.get("embedding_model") != model or stored.get("dimensions") != dimensions or bool(set(fields) - set(table_fields))


def with_authors(hits: DataFrame, sources: DataFrame, blame: DataFrame) -> DataFrame:
    """Adds the author of the line that a hit's snippet names, where the document's first source and
    that line are known; other hits keep a null author. sources: file_path, source (the
    first); blame: path, line, author."""
    line: Column = F.regexp_extract("snippet", r"行号[：:]\s*(\d+)", 1)
    told = hits.withColumn("_line", F.nullif(line, F.lit("")).cast("int")).join(sources, "file_path", "left")
    lines = blame.select(F.col("path").alias("source"), F.col("line").alias("_line"), "author")
    return told.join(lines, ["source", "_line"], "left").drop("_line", "source")


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic embedding without any model: signed counts of hashed words, length one. It
    stands in for a model wherever none is plugged in; a null text has the zero vector."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dimensions)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.size(F.filter(places, lambda p: p == 2 * i)) - F.size(F.filter(places, lambda p: p == 2 * i + 1))).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0))
