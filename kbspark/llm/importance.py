"""Target-distribution importance resampling: documents are drawn, without replacement, by how much
likelier their hashed word n-grams are in a target collection than in the corpus.

Long texts are cut at word boundaries into chunks with an overlap of n - 1 words, so that no task has
to hold the counts of one text and no n-gram is lost or counted twice: a chunk owns the n-grams that
start in its own words, and the carried words only complete them. Chunks are dealt over all tasks;
their counts of features and sums of gains are added up by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, slices, stored
from .words import encoded, found, letters

BUCKETS = 10_000
#: Words of a feature at most; the least words of a document that can be drawn.
LONGEST, LEAST_WORDS = 2, 20
#: Texts of more bytes are cut into chunks of that many words.
CHUNK_BYTES, CHUNK_WORDS = 65_536, 8_192
#: Partitions of a sort for each document count of this size.
RANKED_ROWS = 500_000


def _appending() -> np.ndarray:
    """What appending n zero bytes makes of a checksum, by its four bytes, for n below 64 and then for each power of two
    from 64 on: crc32(a + b) is crc32(a) so moved by the length of b, and crc32(b), added without carry."""
    bytes_ = np.arange(256, dtype=np.uint32)
    step = np.zeros(256, np.uint32)
    for bit in range(8):
        own = np.uint32(1 << bit)
        for _ in range(8):
            own = (own >> np.uint32(1)) ^ (np.uint32(0xEDB88320) if own & np.uint32(1) else np.uint32(0))
        step ^= np.where(bytes_ >> bit & 1, own, np.uint32(0))
    one = lambda x: (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
    tables = [np.stack([bytes_ << np.uint32(8 * k) for k in range(4)])]
    for _ in range(63):
        tables.append(one(tables[-1]))
    twice = one(tables[-1])
    for _ in range(64, 64 + 26):
        tables.append(twice)
        twice = _moved(tables[-1], tables[-1])
    return np.stack(tables)


def _moved(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = table[0][x & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ table[k][x >> np.uint32(8 * k) & np.uint32(255)]
    return out


_TABLES: list[np.ndarray] = []


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each a + b from those of a and of b and the length of b."""
    if not _TABLES:
        _TABLES.append(_appending())
    flat, low = _TABLES[0].reshape(-1), (size & 63).astype(np.int64) << 10
    out = flat[low + (first & np.uint32(255))]
    for k in range(1, 4):
        out ^= flat[low + (k << 8) + (first >> np.uint32(8 * k) & np.uint32(255))]
    rest, power = size >> 6, 64
    while rest.any():
        own = np.flatnonzero(rest & 1)
        out[own] = _moved(_TABLES[0][power], out[own])
        rest, power = rest >> 1, power + 1
    return out ^ second


def features(texts: pa.Array, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of binary texts: words of each, the buckets of all features (repeats included), and the row of each feature.
    ``owned``: of each text, how many of its first words features start in; all if not given."""
    data, first, start, stop = found(texts, letters(digits=True))
    row = np.searchsorted(first, start, "right") - 1
    words = np.bincount(row, minlength=len(texts))
    if not len(start):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, distinct = encoded(data, start, stop)
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    mine = np.ones(len(start), bool)
    if owned is not None:
        begin = np.cumsum(words) - words
        mine = np.arange(len(start)) - begin[row] < owned[row]
    pair = np.flatnonzero((row[1:] == row[:-1]) & mine[:-1])
    both = joined(spaced[at[pair]], crc[at[pair + 1]], size[at[pair + 1]])
    return words, np.concatenate([crc[at[mine]], both]).astype(np.int64) % BUCKETS, np.concatenate([row[mine], row[pair]])


def chunks(text: bytes, words: int) -> Iterator[tuple[int, bytes]]:
    """A text, A-Z lower-cased, in chunks: how many words each owns, and these words with what is between
    them, and with the n - 1 words after them. A text without words is one chunk that owns none."""
    data, _, start, stop = found([text], letters(digits=True))
    if not len(start):
        yield 0, b""
    for i in range(0, len(start), words):
        own = min(words, len(start) - i)
        last = min(len(start), i + own + LONGEST - 1) - 1
        yield own, data[start[i] : stop[last]].tobytes()


def _dealt(docs: DataFrame, chunk_words: int) -> DataFrame:
    """The chunks of long texts, over all tasks: key columns, owned and text; first marks a text's first chunk."""
    names = ["doc_id", "one", "two", "owned", "first", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.slice(i, 1)
                held: list = []
                for n, own in enumerate(chunks(key.column("text")[0].as_py(), chunk_words)):
                    held.append((own[0], n == 0, own[1]))
                    if len(held) == 64:
                        yield rows(key, held)
                        held = []
                if held:
                    yield rows(key, held)

    def rows(key: pa.RecordBatch, held: list) -> pa.RecordBatch:
        keys = [pa.concat_arrays([key.column(c)] * len(held)) for c in ("doc_id", "one", "two")]
        return pa.RecordBatch.from_arrays([*keys, pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held]), pa.array([h[2] for h in held], pa.binary())], names=names)

    # Rows that share both an identifier and a text are told apart by their number alone.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("one"), F.hash("text").alias("two"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_ = keyed.mapInArrow(cut, f"doc_id {kind}, one long, two int, owned long, first boolean, text binary")
    return stored(cut_.repartition(docs.sparkSession.sparkContext.defaultParallelism * 4), "chunks")


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features each bucket has, over columns text and owned (null: all): a fixed number of sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_features(part)[1], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owned = part.column("owned").fill_null(1 << 62).to_numpy(zero_copy_only=False)
    return features(part.column("text"), owned)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 ln) of its share in the target over its share in the corpus, one added to each count."""
    s, t = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _summed(texts: DataFrame, gain: np.ndarray, keys: list[str]) -> DataFrame:
    """Columns ``keys``, and n_words, n_features and the sum of gains of each row's own features."""
    state = texts.sparkSession.sparkContext.broadcast(gain)  # 10,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, bucket, row = _features(part)
                owned = np.minimum(words, part.column("owned").fill_null(1 << 62).to_numpy(zero_copy_only=False))
                n, total = np.bincount(row, minlength=part.num_rows), np.zeros(part.num_rows, np.int64)
                np.add.at(total, row, state.value[bucket])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(owned), pa.array(n), pa.array(total)], names=[*keys, "n_words", "n_features", "gain"])

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "owned", "text").mapInArrow(run, f"{kinds}, n_words long, n_features long, gain long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, chunk_bytes: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_features, weight (the floored mean of its features' gains; 0 without features), score
    (weight and Gumbel noise from a hash of seed and identifier) and rank (from 1, null if not drawn):
    drawn are the ``percent`` of 100 documents of at least ``LEAST_WORDS`` words with the highest scores.

    Null texts have no features. Ties go to the smaller identifier, a null one comes last and is hashed as an
    empty one; among rows with equal score and identifier any order. Rows that are equal in identifier and text
    each count.
    """
    spark = docs.sparkSession
    ship(spark)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    long = F.octet_length("text") > chunk_bytes
    short = whole.filter(~long).withColumn("owned", F.lit(None).cast("long"))
    dealt = _dealt(whole.filter(long), chunk_words)
    corpus = _bucket_counts(short.select("text", "owned").unionByName(dealt.select("text", "owned")))
    wanted = _bucket_counts(target.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.lit(None).cast("long").alias("owned")))
    gain = gains(corpus, wanted)
    of_chunks = _summed(dealt, gain, ["doc_id", "one", "two", "first"]).groupBy("doc_id", "one", "two")
    sums = of_chunks.agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")), F.count(F.when(F.col("first"), 1)).alias("copies"))
    of_long = sums.select("doc_id", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "gain")), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    every = _summed(short, gain, ["doc_id"]).unionByName(of_long)
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((place + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.expr("gain div n_features - CASE WHEN gain % n_features < 0 THEN 1 ELSE 0 END")).otherwise(0)
    scored = stored(every.withColumn("weight", weight.cast("long")).withColumn("score", (F.col("weight") + noise).cast("long")).select("doc_id", "n_words", "n_features", "weight", "score"), "scores")
    return _ranked(scored, percent)


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Adds rank: documents are sorted in ranges, and each range starts after the rows of those before it."""
    can = scored.filter(F.col("n_words") >= LEAST_WORDS)
    n = can.count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = max(scored.sparkSession.sparkContext.defaultParallelism, -(-n // RANKED_ROWS))
    placed = stored(can.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    # The identifier has the range in its upper bits and the place there in the lower 33.
    placed = placed.withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    starts = placed.groupBy("range").count().withColumn("before", F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.coalesce("before", F.lit(0)) + F.col("place") + 1
    # One row for each range, so it may be broadcast.
    ranks = placed.join(F.broadcast(starts.select("range", "before")), "range").withColumn("rank", F.when(rank <= percent * n // 100, rank))
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < LEAST_WORDS).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranks.select(*names, F.col("rank").cast("long")).unionByName(rest)


ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
w AS (SELECT doc_id, true AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT doc_id, own, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
  lambda c, x: xor(c // 256, tab[xor(c % 256, x)::BIGINT + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
n AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM f JOIN b ON b.f = f.f GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (z.s + 10000) / ((n.s + 1) * (z.t + 10000))))::BIGINT AS gain FROM n, z),
d AS (SELECT f.doc_id, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN b ON b.f = f.f JOIN g ON g.bucket = b.bucket WHERE f.own GROUP BY f.doc_id),
r AS (SELECT w.doc_id, len(w.w) AS words, coalesce(d.n, 0) AS n_features, CASE WHEN d.n > 0 THEN floor(d.gain / d.n)::BIGINT ELSE 0 END AS weight, substr(sha256('7:' || w.doc_id), 1, 8) AS h
  FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE w.own),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((list_reduce(list_concat([0::BIGINT], list_transform(range(8), lambda i: (instr('0123456789abcdef', substr(h, i + 1, 1)) - 1)::BIGINT)), lambda a, x: a * 16 + x) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE words >= 20)
SELECT s.doc_id, s.n_features::BIGINT AS n_features, s.weight::BIGINT AS weight, s.score::BIGINT AS score, CASE WHEN k.rank <= 25 * k.n // 100 THEN k.rank END::BIGINT AS rank FROM s LEFT JOIN k ON k.doc_id = s.doc_id
"""
