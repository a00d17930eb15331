"""Best-fit packing of token sequences, repacked until lower bounds certify the number of bins.

Pieces of documents are dealt to partitions by a hash, and each partition packs its own by
best-fit decreasing. Dual-feasible functions give each partition, and all of them together, a
number of bins below which no packing can go. Where bins stand above their bound, partitions
exchange documents: loose bins go, whole, to fewer partitions, which rerun best-fit decreasing
on what they hold and keep the result where it takes fewer bins. Partitions that reach their
bound keep all but their emptiest bins, since rounding leaves each of them one bin to share.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_names, ship, slices, stored
from .encoding import ENTRIES, encoder

#: Pieces in a partition that packs on its own: it holds a few numbers for each.
PER_PARTITION = 50_000
#: The emptiest bins that a partition at its bound gives to an exchange.
SHARED_BINS = 4


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = ENTRIES) -> DataFrame:
    """The pieces of each document's ids followed by ``end_id``: doc_id, piece, start, length,
    ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit integers).

    Only documents of more than ``capacity`` tokens are cut, into pieces of ``capacity``; the
    first piece takes what is left over. Null texts count as empty ones: they give one piece of
    length 1. Null and repeated identifiers pass through.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, cache_entries), struct.pack("<I", end_id)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = encode.encode(text) + end
                    n = len(ids) // 4
                    start, stop, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                    while start < n:
                        own = ids[4 * start : 4 * stop]
                        rows.append((row, piece, start, stop - start, zlib.crc32(own), own)[: 5 + with_ids])
                        start, stop, piece = stop, stop + capacity, piece + 1
                row, *rest = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=False))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each size its bin and its offset there, and the fill of each bin.

    A bit mask holds which amounts of free space some bin has, so the bin with the least space
    that suffices is found in one step.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        above = mask >> size
        if above and size:
            free = size + (above & -above).bit_length() - 1
            own = with_free[free].pop()
            if not with_free[free]:
                mask ^= 1 << free
        else:
            own, free = len(fill), capacity
            fill.append(0)
        bins[item], offsets[item] = own, fill[own]
        fill[own] += size
        if free > size:
            with_free[free - size].append(own)
            mask |= 1 << (free - size)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[s]`` is the number of pieces of size s.

    Each dual-feasible function maps sizes so that no bin's mapped sizes sum to more than the
    capacity; the mapped total over the capacity is then a bound. Three families are tried: the
    identity; for a threshold t, sizes over capacity - t count as whole bins and sizes under t as
    nothing; for k, sizes round down to multiples of capacity / k, counted in steps of k + 1.
    """
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    number, weight = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * sizes)
    for t in range(1, capacity // 2 + 1):
        whole = int(number[capacity - t + 1])
        middle = int(weight[capacity - t] - weight[t - 1])
        best = max(best, -(-(whole * capacity + middle) // capacity))
    for k in range(1, 33):
        exact = (k + 1) * sizes % capacity == 0
        # k * capacity is the common denominator of both branches.
        mapped = np.where(exact, k * sizes, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, before: int) -> Iterator[pa.RecordBatch]:
    """Packs one partition, of which ``before`` were packed in earlier rounds. Rows that already have bins (bin is not
    null) keep them unless fewer do."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    sizes = rows.column("length").to_numpy().astype(np.int64)
    bins, offsets, fill = best_fit(sizes, capacity)
    bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    old = rows.column("sequence_id")
    if old.null_count == 0:
        names, back = np.unique(old.to_numpy(), return_inverse=True)
        if len(names) <= len(fill):
            bins, offsets = back, rows.column("offset").to_numpy()
            fill = np.bincount(back, weights=sizes).astype(np.int64)
    gap = len(fill) - bound
    free = capacity - fill
    loose = free > 0
    if gap <= 0:  # certified: only the emptiest bins can serve others
        kept = np.ones(len(fill), bool)
        kept[np.argsort(-free, kind="stable")[:SHARED_BINS]] = False
        loose &= ~kept
    first = (before + TaskContext.get().partitionId()) << 32
    out = {"sequence_id": pa.array(first + bins), "offset": pa.array(offsets, pa.int64()), "loose": pa.array(loose[bins])}
    for name, values in out.items():
        rows = rows.set_column(rows.schema.get_field_index(name), name, values)
    yield from rows.to_batches(max_chunksize=8192)


def pack(pieces: DataFrame, capacity: int, per_partition: int = PER_PARTITION) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; other columns pass
    through, and a clash with the names added here is an error. An empty table stays empty.

    Every partition holds about ``per_partition`` rows whatever the data, since rows are dealt by a
    number of their own. Exchanges go on as long as a round saves a sequence. What the driver gets is one
    count for each length. ``certificate`` of the result holds the number of sequences and the lower
    bound on it. A length that is null or out of range is an error.
    """
    check_names(pieces, ["sequence_id", "offset", "loose", "_row"])
    ship(pieces.sparkSession)
    added = {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "loose": F.lit(True)}
    rows = stored(pieces.withColumn("_row", F.monotonically_increasing_id()).withColumns(added), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    inside = F.col("length").between(1, capacity)
    for row in rows.groupBy(F.when(inside, F.col("length")).alias("length")).count().collect():  # at most one row for each length
        if row["length"] is None:
            raise ValueError(f"{row['count']} rows have a length that is null or not in 1 to {capacity}")
        counts[row["length"]] = row["count"]
    n_full, counts[capacity] = int(counts[capacity]), 0
    done = [rows.filter(F.col("length") == capacity).withColumns({"sequence_id": F.lit(255 << 55).cast("long") + F.col("_row"), "offset": F.lit(0).cast("long")})]
    loose, n_loose, bound = rows.filter(F.col("length") < capacity), int(counts.sum()), lower_bound(counts, capacity)
    schema, settled, parts = rows.schema, 0, -(-int(counts.sum()) // per_partition)
    before, mark, packed_parts = None, 0, 0  # sequences are numbered by partitions of all rounds
    while n_loose:
        mark += 1
        key = "_row" if mark == 1 else "sequence_id"
        dealt = loose.repartition(max(1, parts), F.xxhash64(key))
        packed = stored(dealt.mapInArrow(lambda batches, n=packed_parts: _packed(batches, capacity, n), schema), f"packed-{mark}")
        found = packed.groupBy("loose").agg(F.countDistinct("sequence_id").alias("bins"), F.count("*").alias("n"), F.max("sequence_id").alias("last")).collect()
        packed_parts = max(r["last"] >> 32 for r in found) + 1
        bins = {r.loose: r.bins for r in found}
        n = {r.loose: r.n for r in found}
        done.append(packed.filter(~F.col("loose")))
        settled += bins.get(False, 0)
        loose, n_loose = packed.filter("loose"), n.get(True, 0)
        sequences = settled + bins.get(True, 0)
        if sequences <= bound or parts <= 1 or (before is not None and sequences >= before):
            done.append(loose)
            settled = sequences
            break
        before, parts = sequences, -(-n_loose // per_partition)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.drop("loose", "_row")
    out.certificate = {"sequences": settled + n_full, "at_least": bound + n_full}
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = ENTRIES) -> DataFrame:
    """Cuts and packs: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset. ``cache_entries`` bounds what a
    worker keeps of words' ids; it changes speed and memory only."""
    return pack(cut(docs, tokenizer_path, end_id, capacity, with_ids, id_col, text_col, cache_entries), capacity)
