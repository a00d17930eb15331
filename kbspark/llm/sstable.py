"""Token ids of documents in sorted-string-table shards.

File format (all integers little-endian, varints as 7-bit groups, low group first)::

    magic   b"KSST0001"
    block*  zstd frame of entries, then crc32 (4 bytes) of the frame
            entry: varint bytes shared with the previous key, varint bytes of the rest of the
            key, varint ids, the rest of the key, the ids (2 bytes each where the shard's
            ids are all below 65536, else 4); the first entry of a block shares nothing
    index   zstd frame; for each block: varint bytes of its first key, the key, varint offset,
            varint length, varint entries
    bloom   bits of a Bloom filter over the keys
    meta    JSON: ids, documents, id width, hashes and bits of the filter
    footer  offset and length of index, bloom and meta (8 bytes each), then the magic

Keys sort as the identifiers do: 0x00 for a null identifier, else 0x01 and the big-endian
64-bit identifier with its sign bit flipped. Shards hold disjoint ranges of keys in order.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, ship, slices, stored
from .encoding import encoder

MAGIC = b"KSST0001"
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    """Double hashing: the halves of one 128-bit hash give all probes."""
    h = xxhash.xxh128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b & (1 << 64) - 1) % bits for i in range(HASHES)]


class ShardWriter:
    """Takes keys in ascending order; equal keys may repeat."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at, self.block, self.held, self.entries = 0, [], 0, 0
        self.first = self.last = b""
        self.index, self.keys = [], []
        self.docs = self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        if self.docs and key < self.keys[-1]:
            raise ValueError("keys must come in ascending order")
        n = len(ids) // 4
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        rest = key[shared:]
        self.block += [_varint(shared), _varint(len(rest)), _varint(n), rest, ids]
        self.held += len(ids) + len(rest) + 6
        self.last, self.entries = key, self.entries + 1
        self.docs, self.ids = self.docs + 1, self.ids + n
        self.keys.append(key)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            frame = self.pack.compress(b"".join(self.block))
            self.index.append(_varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(frame)) + _varint(self.entries))
            self._write(frame + struct.pack("<I", zlib.crc32(frame)))
            self.block, self.held, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        meta = {"documents": self.docs, "ids": self.ids, "width": self.width, "hashes": HASHES, "bits": bits}
        parts = [self.pack.compress(b"".join(self.index)), np.packbits(bloom, bitorder="little").tobytes(), json.dumps(meta).encode()]
        places = []
        for part in parts:
            places += [self.at, len(part)]
            self._write(part)
        self._write(struct.pack("<6Q", *places) + MAGIC)


class ShardReader:
    """Looks documents up by binary search, or reads them in order, over a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        foot = self._at(size - 56, 56)
        if foot[48:] != MAGIC:
            raise ValueError("not a shard, or one that was cut short")
        i, n, j, m, k, o = struct.unpack("<6Q", foot[:48])
        self.meta = json.loads(self._at(k, o))
        self.bloom = self._at(j, m)
        self.blocks, at, index = [], 0, self._unpack(self._at(i, n))
        while at < len(index):
            size, at = _read_varint(index, at)
            key, at = index[at : at + size], at + size
            offset, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            entries, at = _read_varint(index, at)
            self.blocks.append((key, offset, length, entries))
        self.firsts = [b[0] for b in self.blocks]

    @staticmethod
    def _unpack(frame: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(frame)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, entries = self.blocks[block]
        frame = self._at(offset, length + 4)
        if struct.unpack("<I", frame[length:])[0] != zlib.crc32(frame[:length]):
            raise ValueError("a block is damaged")
        data, at, key, width = self._unpack(frame[:length]), 0, b"", self.meta["width"]
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            ids, at = data[at : at + n * width], at + n * width
            yield key, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for block in range(len(self.blocks)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.meta["bits"]))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry under this identifier."""
        key, found = key_of(doc_id), []
        if not self.blocks or not self.may_hold(doc_id):
            return found
        block = max(0, bisect_right(self.firsts, key) - 1)
        while block and self.firsts[block] == key:
            block -= 1
        while block < len(self.blocks) and self.firsts[block] <= key:
            found += [ids for k, ids in self._entries(block) if k == key]
            block += 1
        return found


def open_shard(path: str) -> ShardReader:
    store, inner = fs.FileSystem.from_uri(path)
    return ShardReader(store.open_input_file(inner))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes shards in ascending order of identifiers.

    Returns the manifest: part, path, documents, ids, start (ids in the shards before), min_id,
    max_id. A shard gets its name only once it is whole, and only attempts that Spark accepted
    are in the manifest, so lost executors and repeated attempts do no harm. Null texts count as
    empty ones; a null identifier sorts first; repeated identifiers are all kept; an empty table
    gives an empty manifest. Other columns are not read. Rows of one identifier stay in one
    shard, which streams them, so memory does not grow with them; the keys of a shard are held
    for its filter.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "sst")
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    # Ids below 65536 take two bytes: the vocabulary, not the data, decides.
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer, out, low, high = encoder(tokenizer_path), None, None, None, None
        width = 2 if max(encode.library.get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
        end = struct.pack("<I", end_id)
        store, inner = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if writer is None:
                        store.create_dir(inner, recursive=True)
                        out, low = store.open_output_stream(f"{inner}/_{name}"), doc_id
                        writer = ShardWriter(out, width)
                    writer.add(key_of(doc_id), encode.encode(text) + end)
                    high = doc_id
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{inner}/_{name}", f"{inner}/{name}.sst")
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{name}.sst"], "documents": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "min_id": pa.array([low], pa.int64()), "max_id": pa.array([high], pa.int64())})

    manifest = stored(ranged.mapInArrow(write, "part int, path string, documents long, ids long, min_id long, max_id long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32, shard and, if asked for, ids (binary,
    little-endian unsigned 32-bit integers). One row for each document that was written."""
    ship(manifest.sparkSession)
    # As many partitions as shards: the rows are tiny, so Spark would put them all in one task.
    shards = manifest.select("path", "start").repartitionByRange(max(1, manifest.count()), F.col("start"), F.col("path"))
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "shard": pa.string()} | ({"ids": pa.binary()} if with_ids else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, ids in open_shard(path).scan():
                    n = len(ids) // 4
                    rows.append((doc_id, start, n, zlib.crc32(ids), path, ids)[: len(kinds)])
                    start += n
                    held += len(ids) * with_ids
                    if len(rows) >= 8192 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string" + ", ids binary" * with_ids)


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> dict[int | None, list[bytes]]:
    """Ids of a few documents, by identifier (null too; one that is not stored may be absent): the manifest's ranges (a null start is the null identifier's, which comes
    first), then the filter, then binary search."""
    found: dict[int, list[bytes]] = {}
    for doc_id in doc_ids:
        inside = F.col("min_id").isNull() if doc_id is None else (F.col("min_id").isNull() | (F.col("min_id") <= doc_id)) & (F.col("max_id") >= doc_id)
        for row in manifest.filter(inside).select("path").collect():
            found.setdefault(doc_id, []).extend(open_shard(row.path).get(doc_id))
    return found
