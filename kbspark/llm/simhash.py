"""Near-duplicates by SimHash fingerprints that Burkhard-Keller trees join.

Two fingerprints that differ in at most r of 64 bits agree on at least one of r + 1 blocks of bits,
so each distinct fingerprint goes to the r + 1 shards that its blocks name. A shard holds a
Burkhard-Keller tree (children keyed by their Hamming distance to the parent); a search follows
only edges whose distance is within r of the distance to the node. Shards above a size are split
by the same rule on the bits that are left, so that no task holds more than it should however many
fingerprints share a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, check_names, ship, slices, stored
from .graphs import components

BITS = 64
#: Fingerprints in a shard above which it is split by the bits that its block leaves.
SHARD = 50_000


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash of a text in UTF-8: A-Z lower-cased, words between ASCII white space, shingles of so
    many words (all of them if there are fewer), repeats included; a bit is 1 if over half of the
    shingles' XXH64 values have it. No word: 0."""
    own = text.lower().split()
    if not own:
        return 0
    if len(own) <= words:
        return xxhash.xxh64_intdigest(b" ".join(own), seed)
    digest = xxhash.xxh64_intdigest
    if words == 3:
        hashes = [digest(b"%b %b %b" % x, seed) for x in zip(own, own[1:], own[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(own[i : i + words]), seed) for i in range(len(own) - words + 1)]
    return simhash(hashes)


def simhash(hashes) -> int:
    """A bit is 1 if over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[first : first + (1 << 16)], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long). A null text counts as an empty one."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """A tree over distinct integers; each child hangs on its Hamming distance to the parent."""

    def __init__(self, values=()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.values:
            node = 0
            while True:
                distance = (value ^ self.values[node]).bit_count()
                below = self.children[node].get(distance)
                if below is None:
                    self.children[node][distance] = len(self.values)
                    break
                node = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values within the radius."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                yield node
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)


class BulkBKTree:
    """The same tree over an array, walked by many searches at a time: at each node the searches
    that are still alive split among the edges that they may follow. Nodes of few values end in
    a leaf that is compared as a whole."""

    LEAF = 128

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, dict[int, int]] | np.ndarray] = []
        todo = [(np.arange(len(values)), None, 0)]
        while todo:
            own, parent, edge = todo.pop()
            if parent is not None:
                self.nodes[parent][1][edge] = len(self.nodes)
            if len(own) <= self.LEAF:
                self.nodes.append(own)
                continue
            self.nodes.append((int(own[0]), {}))
            distance = np.bitwise_count(values[own[1:]] ^ values[own[0]])
            todo += [(own[1:][distance == d], len(self.nodes) - 1, int(d)) for d in np.unique(distance)]

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs of values within the radius, in blocks."""
        values = self.values
        todo = [(0, np.arange(len(values)))] if self.nodes else []
        while todo:
            at, alive = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                for first in range(0, len(alive), 8192):
                    some = alive[first : first + 8192]
                    a, b = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[node][None, :]) <= radius)
                    yield some[a], node[b]
                continue
            pivot, edges = node
            distance = np.bitwise_count(values[alive] ^ values[pivot]).astype(np.int64)
            near = alive[distance <= radius]
            yield near, np.full(len(near), pivot)
            for edge, child in edges.items():
                if len(rest := alive[np.abs(distance - edge) <= radius]):
                    todo.append((child, rest))


def _spanning(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs within the radius, no more than needed to connect what they connect."""
    root, out = list(range(len(values))), []

    def join(i: int, j: int) -> bool:
        ends = []
        for k in (i, j):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            ends.append(k)
        if ends[0] == ends[1]:
            return False
        root[ends[0]] = ends[1]
        out.append((values[i], values[j]))
        return True

    if len(values) <= 256:
        tree = BKTree()
        for i, value in enumerate(values):
            for j in tree.within(value, radius):
                join(i, j)
            tree.add(value)
        return out
    label = np.arange(len(values))  # components so far; most pairs of a dense group fall out here
    for a, b in BulkBKTree(np.array(values, np.uint64)).within(radius):
        while len(apart := np.flatnonzero(label[a] != label[b])):
            a, b = a[apart], b[apart]
            _, first = np.unique(label[a] * len(values) + label[b], return_index=True)
            for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
                join(i, j)
            flat = np.array(root)
            while not np.array_equal(flat, flat[flat]):
                flat = flat[flat]
            label = flat
    return out


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def links(prints: DataFrame, radius: int = 3, shard_size: int = SHARD) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp of ``prints``) within the radius: for each
    shard those that connect what it holds, so the components of all pairs are the components
    of these. Shards are streamed one after the other; a shard that the first split leaves above
    ``shard_size`` is split again by its other bits, which keeps the result exact.
    """
    blocks = radius + 1
    distinct = prints.filter("fp is not null").select("fp").distinct()

    def masks(bits: list[int]) -> list[int]:
        """Splits the given bit places into radius + 1 blocks."""
        cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
        return [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(blocks)]

    first = masks(list(range(BITS)))
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in first]
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)))).alias("key")).select("fp", "key.block", "key.part")
    sizes = keyed.groupBy("block", "part").count().filter(F.col("count") > shard_size)
    large = stored(sizes.select("block", "part"), "large-shards")
    second = {i: masks([b for b in range(BITS) if not first[i] >> b & 1]) for i in range(blocks)}

    def refine(i: int):
        found = [m - (1 << BITS) if m >> (BITS - 1) else m for m in second[i]]
        return F.array(*(F.struct(F.lit(1 + k).alias("sub"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for k, m in enumerate(found)))

    small = keyed.join(large, ["block", "part"], "left_anti").select("fp", "block", "part", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("rest"))
    cases = F.when(F.col("block") == 0, refine(0))
    for i in range(1, blocks):
        cases = cases.when(F.col("block") == i, refine(i))
    again = keyed.join(large, ["block", "part"], "left_semi").select("fp", "block", "part", F.explode(cases).alias("s")).select("fp", "block", "part", "s.sub", "s.rest")
    shards = (small if large.isEmpty() else small.unionByName(again)).select("fp", F.xxhash64("block", "part", "sub", "rest").alias("shard"))
    dealt = shards.repartition(F.col("shard")).sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held = None, []

        def flush() -> list[tuple[int, int]]:
            return _spanning(held, radius) if len(held) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            shard = batch.column("shard").to_numpy()
            values = batch.column("fp").to_numpy().view(np.uint64)
            starts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for low, high in zip(starts, starts[1:], strict=False):
                if low == high:
                    continue
                if shard[low] != held_shard:
                    found += flush()
                    held_shard, held = shard[low], []
                held += values[low:high].tolist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(_signed([p[i] for p in found])) for i in range(2)], names=["a", "b"])
        if found := flush():
            yield pa.RecordBatch.from_arrays([pa.array(_signed([p[i] for p in found])) for i in range(2)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _named(least: DataFrame, radius: int) -> DataFrame:
    """Per distinct fingerprint (columns fp and least): the smallest ``least`` of its component.
    Both sides of each join are written, so that Spark can split a hot key."""
    roots = components(links(least, radius))
    named = stored(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    names = stored(named.groupBy("root").agg(F.min("least").alias("first")), "names")
    return stored(named.join(names, "root").select("fp", "first"), "components")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id that links
    reach, itself included) for every row.

    Texts without a word, null ones among them, have fingerprint 0 and link with each other. Rows
    with a null identifier get a fingerprint and take part in links; they never name a component
    unless all of it is null. Repeated rows stay. An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = prints.join(_named(least, radius), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the smallest identifier, null
    ones last; of rows that share it, one. Fingerprints and row numbers are written with the
    rows, so that all steps see the same numbers."""
    def make():
        return lambda texts: [(int(np.uint64(fingerprint((t or "").encode(), words)).astype(np.int64)),) for t in texts]

    check_names(docs, ["_row", "_fp"])
    rows = stored(annotated(docs, text_col, {"_fp": "long"}, make).withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    least = stored(rows.select(F.col("_fp").alias("fp"), order.alias("o")).groupBy("fp").agg(F.min("o").alias("least")), "prints")
    first = _named(least, radius).select(F.col("first.row").alias("_row")).distinct()
    return rows.join(first, "_row", "left_semi").select(*docs.columns)
