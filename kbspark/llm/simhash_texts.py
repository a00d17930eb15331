"""Near-duplicate texts: SimHash fingerprints joined by Burkhard-Keller trees, confirmed by the exact
Jaccard similarity of word shingles.

A radius of 3 bits, which separates fingerprints without looking at texts, misses most pairs of
similarity 0.8: these differ in about ten of 64 bits, and random texts in 32. So the search goes to
RADIUS bits, and every pair it finds is confirmed on the texts. No split of 64 bits into blocks
separates texts at such a radius; the shards that hold the trees are therefore those of prefix filtering:

Put the shingles of all texts in one order. Of two sets whose similarity is at least t, the
first |x| - ceil(t |x|) + 1 shingles of each share one. So each fingerprint goes to the shards of its
text's first shingles, and no similar pair has all its shards apart, whatever the order. Shingles that
a sample finds often come last, which keeps the shards small. Members of a small shard are compared at
once; in a large one the member nearest to the majority of the fingerprints, bit by bit, is compared with
all others first, and a tree joins what these links leave apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, check_names, discard, slices, small_side, stored
from .graphs import components
from .simhash import BulkBKTree, simhash

#: Texts, at most (about), in which frequent shingles are sought, and how often makes one frequent.
SAMPLE, OFTEN = 8_000, 3
#: Shards of the prefixes at least, their entries (about); shingles that more sets than LARGE share are
#: linked in two rounds.
SHARDS, PER_SHARD, LARGE = 256, 1 << 20, 32
#: Texts of the sample that have a shingle from which on its entries are not dealt to one shard.
HOT = 16
#: Entries that a task holds before it passes them on.
FLUSH = 1 << 18
#: Bits in which fingerprints of similar texts may differ. For sets of similarity 0.8 the number is close to binomial
#: with mean 9.7 and deviation 2.9: one pair in a hundred million is further apart. That holds for sets of many
#: shingles; pairs with a set of fewer than SMALL go to confirmation whatever their fingerprints are.
RADIUS, SMALL = 28, 64
#: Members of a block of a large group: blocks are compared two at a time, each pair in a task of its own.
BLOCK = 8_192


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each distinct shingle, ascending: A-Z lower-cased, words between ASCII white space;
    a text of fewer words is one shingle, a text without words has none."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(x)) for x in zip(*(own[i:] for i in range(min(words, len(own)))), strict=False)], np.uint64))


def key(own: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).astype(np.int64))


def prefix(own: np.ndarray, least: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first in the order; frequent ones, ascending, are put last."""
    size = len(own) - math.ceil(least * len(own) - 1e-9) + 1
    if not len(own) or not len(frequent):
        return own[:size]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    return own[np.lexsort((own, np.where(frequent[at] == own, rank[at], 0)))[:size]]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _frequent(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of distinct texts, ascending, and their ranks. Its size is bounded."""
    n = docs.count()
    texts = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = {key(x): x for x in (shingles(t, words) for t in part.column("text").to_pylist())}
                own = np.concatenate(list(found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()]))], names=["s", "k"])

    counted = some.mapInArrow(run, "s long, k long").distinct().groupBy("s").count().filter(F.col("count") >= OFTEN)
    got = counted.orderBy(F.desc("count"), "s").limit(200_000).toArrow()
    own, n = got["s"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(own)
    return own[order], n[order]


def _blob(rows: np.ndarray) -> bytes:
    """Entries (shingle, key, fingerprint, size, place), ascending by shingle: differences of shingles, byte planes apart."""
    gaps = np.diff(rows["s"], prepend=np.uint64(0))
    return b"".join((gaps if name == "s" else rows[name]).astype(kind).view(np.uint8).reshape(len(rows), -1).T.tobytes() for name, kind in FIELDS)


FIELDS = [("s", "<u8"), ("k", "<i8"), ("f", "<u8"), ("n", "<u4"), ("p", "<u4")]
ENTRY = np.dtype(FIELDS)


def _entries(data: bytes) -> np.ndarray:
    size = len(data) // ENTRY.itemsize
    rows, at = np.empty(size, ENTRY), 0
    for name, kind in FIELDS:
        width = np.dtype(kind).itemsize
        rows[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8, width * size, at).reshape(width, -1).T).view(kind).ravel()
        at += width * size
    rows["s"] = np.cumsum(rows["s"], dtype=np.uint64)
    return rows


def _ordered(parts: list[np.ndarray]) -> np.ndarray:
    """Entries by shingle, size and key, each once."""
    own = np.concatenate(parts)
    own = own[np.lexsort((own["k"], own["n"], own["s"]))]
    same = (own["s"][1:] == own["s"][:-1]) & (own["k"][1:] == own["k"][:-1])
    return own[np.append(True, ~same)]


def _prefixes(rows: DataFrame, words: int, least: float, text_col: str, frequent, shards: int) -> DataFrame:
    """shard and entries: what each task found, packed. Shingles that the sample found often may have any
    number of entries, which would meet in one task: those are plain rows, as ``_met`` gives them."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)  # of a bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, zip_ = [], 0, zstandard.ZstdCompressor(level=1)
        hot = sent.value[0][sent.value[1] >= HOT]

        def out() -> Iterator[pa.RecordBatch]:
            own = _ordered(held)
            often = np.isin(own["s"], hot)
            many = own[often]
            # Dealt by their keys, not by their shingle.
            spread = (many["k"].view(np.uint64) % np.uint64(shards)).astype(np.int32)
            plain = [pa.array(x) for x in (many["s"].view(np.int64), many["k"].astype(np.int64), many["f"].view(np.int64), many["n"].astype(np.int64), many["p"].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(many), pa.binary()), *plain], names=["shard", "entries", *"skfnp"])
            own = own[~often]
            shard = (own["s"] >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            found = [(s, zip_.compress(_blob(own[cuts[s] : cuts[s + 1]]))) for s in np.flatnonzero(np.diff(cuts)).tolist()]
            nothing = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary()), *[nothing] * 5], names=["shard", "entries", *"skfnp"])

        for batch in batches:
            for part in slices(batch, "text"):
                for k, f, text in zip(*(part.column(c).to_pylist() for c in ("_key", "_fp", "text")), strict=True):
                    own = shingles(text, words)
                    first = prefix(own, least, *sent.value)
                    entry = np.empty(len(first), ENTRY)
                    entry["s"], entry["k"], entry["f"], entry["n"], entry["p"] = first, k, np.int64(f).view(np.uint64), len(own), np.arange(len(first))
                    held.append(entry)
                    size += len(first)
                    if size >= FLUSH:
                        yield from out()
                        held, size = [], 0
        if size:
            yield from out()

    texts = rows.select("_key", "_fp", F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return texts.mapInArrow(run, "shard int, entries binary, s long, k long, f long, n long, p long")


def _met(prefixes: DataFrame, least: float, shards: int) -> DataFrame:
    """What meets under a shingle: pairs a, b to confirm of a small group; and the members of large groups:
    s (shingle), k (key), f (fingerprint), n (size), p (the shingle's place among the set's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()

        def out(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            own = _ordered([_entries(unzip.decompress(x)) for x in blobs])
            starts = np.flatnonzero(np.append(True, own["s"][1:] != own["s"][:-1]))
            sizes = np.diff(np.append(starts, len(own)))
            size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
            at = np.flatnonzero((size > 1) & (size <= LARGE))
            left = own["n"].astype(np.int64) - own["p"]  # what the sets can share from here on
            low, high = [], []
            for lag in range(1, LARGE):
                at = at[at + lag < first[at] + size[at]]
                at = at[own["n"][at + lag] * least <= own["n"][at] + 1e-9]  # sizes ascend: more lag is no better
                ok = at[np.minimum(left[at], left[at + lag]) >= least / (1 + least) * (own["n"][at].astype(np.int64) + own["n"][at + lag]) - 1e-9]
                ok = ok[(np.bitwise_count(own["f"][ok] ^ own["f"][ok + lag]) <= RADIUS) | (own["n"][ok] < SMALL)]  # the smaller of the two
                low.append(ok)
                high.append(ok + lag)
            both = np.stack([own["k"][np.concatenate(low)], own["k"][np.concatenate(high)]], axis=1)
            both = np.unique(np.sort(both[both[:, 0] != both[:, 1]], axis=1), axis=0)
            yield _rows(a=both[:, 0], b=both[:, 1])
            many = own[size > LARGE]
            yield _rows(s=many["s"].view(np.int64), k=many["k"], f=many["f"].view(np.int64), n=many["n"], p=many["p"])

        shard, held = None, []
        for batch in batches:
            often = batch.filter(pc.is_null(batch.column("entries")))
            yield _rows(**{c: often.column(c).to_numpy() for c in "skfnp"})
            batch = batch.filter(pc.is_valid(batch.column("entries")))
            for now, blob in zip(batch.column("shard").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if now != shard and held:
                    yield from out(held)
                    held = []
                shard = now
                held.append(blob)
        if held:
            yield from out(held)

    dealt = prefixes.repartition(shards, F.col("shard")).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "a long, b long, s long, k long, f long, n long, p long")


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(size, pa.int64()) for c in "abskfnp"], names=list("abskfnp"))


def _stars(members: DataFrame, least: float) -> DataFrame:
    """Pairs a, b of each large group's centre and its other members. The centre is the member whose
    fingerprint is nearest to the majority of all, bit by bit: of copies of one text with a change
    here and there, that is the text. Sums by group are taken before the shuffle, and the sides of
    joins are written, so a group of any size is split."""
    bits = [F.sum(F.shiftright("f", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    sums = members.groupBy("s").agg(F.count("*").alias("of"), *bits)
    majority = F.lit(0).cast("long")
    for i in range(64):
        majority = majority.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("of"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    sums = stored(sums.select("s", majority.alias("m")), "majorities")
    away = members.join(sums, "s").select("s", F.struct(F.bit_count(F.col("f").bitwiseXOR(F.col("m"))).alias("d"), "k", "f", "n").alias("o"))
    centres = stored(away.groupBy("s").agg(F.min("o").alias("c")).select("s", "c.*").toDF("s", "d", "ck", "cf", "cn"), "centres")
    near = members.join(centres, "s").filter((F.col("k") != F.col("ck")) & ((F.bit_count(F.col("f").bitwiseXOR(F.col("cf"))) <= RADIUS) | (F.least("n", "cn") < SMALL)) & (F.least("n", "cn") >= least * F.greatest("n", "cn") - 1e-9))
    return near.select(F.least("k", "ck").alias("a"), F.greatest("k", "ck").alias("b")).distinct()


def _apart(members: DataFrame, least: float) -> DataFrame:
    """Pairs a, b of members of a large group (columns s, k, f, n, p, root) that no link has joined so far,
    found by Burkhard-Keller trees over the group's fingerprints. Only pairs that can be similar with
    this shingle as the first that they share: texts that share a passage everybody has drop out. A group is cut into
    blocks, and each pair of blocks has a task and a tree of its own, so no task holds a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(rows)
            k, f, n, p, root, block, i, j = (own[c].to_numpy() for c in ("k", "f", "n", "p", "root", "own", "i", "j"))
            few = np.flatnonzero(n < SMALL / least)  # partners of small sets
            searches = [(np.arange(len(k)), RADIUS)] + ([(few, 64)] if (n[few] < SMALL).any() else [])
            for who, radius in searches:
                for x, y in BulkBKTree(f[who].view(np.uint64)).within(radius):
                    x, y = who[x], who[y]
                    ok = (x < y) & (root[x] != root[y]) & ((block[x] != block[y]) | (i[0] == j[0])) & (np.minimum((n - p)[x], (n - p)[y]) >= least / (1 + least) * (n[x] + n[y]) - 1e-9)
                    if ok.any():
                        a, b = k[x[ok]], k[y[ok]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("s", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if key[:, low].tolist() != now and held:
                    yield from out(held)
                    held = []
                now = key[:, low].tolist()
                held.append(batch.slice(low, high - low))
        if held:
            yield from out(held)

    blocks = members.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).alias("of"))
    cut = members.join(small_side(stored(blocks, "blocks")), "s").withColumn("own", F.pmod(F.xxhash64("k"), F.col("of")))
    sides = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    sides = sides.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return sides.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, rows: DataFrame, least: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs whose sets have the similarity. Texts travel compressed; sides of joins are written, so
    that hot keys are split."""
    wanted = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct()
    chosen = small_side(stored(wanted.join(least, "_key").select("least.row"), "chosen"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.set_column(2, "text", pa.array([zip_.compress(t or b"") for t in part.column("text").to_pylist()], pa.binary()))

    packed = rows.select("_row", "_key", F.col(text_col).cast("binary").alias("text")).mapInArrow(pack, "_row long, _key long, text binary")
    texts = stored(packed.join(chosen, packed["_row"] == chosen["row"], "left_semi").select("_key", "text"), "texts")
    one = stored(pairs.join(texts.select(F.col("_key").alias("a"), F.col("text").alias("ta")), "a"), "sides")
    two = one.join(texts.select(F.col("_key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "ta"):
                met: dict[int, np.ndarray] = {}
                ok = []
                for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                    for k, t in ((a, ta), (b, tb)):
                        if k not in met:
                            met[k] = shingles(unzip.decompress(t), words)
                    ok.append(similar(met[a], met[b], similarity))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = stored(two.mapInArrow(run, "a long, b long"), "links")
    discard(texts, one)
    return links


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component of rows whose sets of shingles have at least
    that Jaccard similarity (of large sets, whose fingerprints are also within RADIUS bits): the one with the smallest
    identifier, null ones last; of rows that share it, one. Texts without a word, null ones among
    them, are alike. Repeated rows are alike too. An empty table gives an empty one.
    """
    added = {"_row": "long", "_key": "long", "_fp": "long", "_size": "long"}
    check_names(docs, added)

    def make():
        def one(text):
            own = shingles((text or "").encode(), words)
            return key(own), int(np.uint64(simhash(own)).astype(np.int64)), len(own)

        return lambda texts: [one(t) for t in texts]

    rows = stored(annotated(docs, text_col, {c: added[c] for c in ("_key", "_fp", "_size")}, make).withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    least = stored(rows.select("_key", "_size", order.alias("o")).groupBy("_key").agg(F.min("o").alias("least"), F.first("_size").alias("size")), "least")
    entries = least.agg(F.coalesce(F.sum((1 - similarity) * F.col("size") + 1), F.lit(0.0))).first()[0]
    shards = max(SHARDS, 1 << max(0, math.ceil(entries / PER_SHARD) - 1).bit_length())
    firsts = _prefixes(rows, words, similarity, text_col, _frequent(docs, words, text_col), shards)
    met = stored(_met(firsts, similarity, shards), "met")
    members = stored(met.filter("s is not null").select("s", "k", "f", "n", "p").distinct(), "members")
    pairs = stored(met.filter("a is not null").select("a", "b").unionByName(_stars(members, similarity)).distinct(), "pairs")
    discard(met)
    links = _confirmed(pairs, rows, least, words, similarity, text_col)
    if not members.isEmpty():
        roots = stored(components(links), "roots-1").withColumnRenamed("node", "k")
        members = stored(members.join(roots, "k", "left").select("s", "k", "f", "n", "p", F.coalesce("root", "k").alias("root")), "rooted")
        mixed = stored(members.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("s"), "mixed")
        more = _apart(members.join(mixed, "s", "left_semi"), similarity).distinct().join(pairs, ["a", "b"], "left_anti")
        links = links.unionByName(_confirmed(stored(more, "pairs-2"), rows, least, words, similarity, text_col))
    roots = components(links).withColumnRenamed("node", "_key")
    named = stored(least.join(roots, "_key", "left").select("least", F.coalesce("root", "_key").alias("root")), "named")
    first = small_side(stored(named.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.row").alias("_row")), "first"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)
