"""An n-gram language model in Elias-Fano tries, learned and queried in parallel.

The vocabulary is a set of shards, each the sorted 64-bit hashes of its words in Elias-Fano form
with their counts; a word's number is its rank over all shards. Pairs of words are dealt by a hash
of the pair, so that a word that occurs everywhere does not make one shard large, and triples go
where their first two words are. Each shard is a trie of three levels: the words that stand first;
for each, a pointer (a monotone sequence) to its successors; the successors, written as one monotone
sequence in which each context's numbers are offset by its place; then, for each pair, a pointer to
the words after it, written in the same way. Both lower levels hold quantised logarithms of smoothed
probabilities. An n-gram is found by its context's place, the pointers around it and a search among
these successors only.

Smoothing is Bayesian with Dirichlet priors: with N tokens, V distinct ones, n() counts and the
strengths k and l,

    P1(w) = (n(w) + 1) / (N + V + 1),    P2(w | c) = (n(c, w) + k P1(w)) / (n(c) + k),
    P3(w | b, c) = n(b, c, w) / (n(b, c) + l) + l / (n(b, c) + l) P2(w | c),

each of which sums to one over the known words and one class of unknown words. Triples hold the first
term of P3, pairs the weight before P2. The end of a text is a token; it is also the context of a
text's first word, and the end and the first word are the context of the second.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, ship, slices, stored
from .elias_fano import EliasFano, dump, load

#: Not a word, as words hold no white space.
END = b"\n"
#: Weights of the priors of pairs and of triples, in tokens.
STRENGTH, STRENGTH_3 = 400.0, 20.0
#: Tokens for each shard of pairs, and distinct words for each shard of the vocabulary, at most (about).
TOKENS_PER_SHARD, WORDS_PER_SHARD, LEAST_SHARDS = 1 << 20, 1 << 20, 64
#: Shards of the vocabulary, and of the pairs, that a worker holds open at most.
OPEN_SHARDS = 128
#: Logarithms of probabilities are written in steps of this size.
STEP = 1 / 4096
#: Tokens whose pairs a task counts before it passes them on.
FLUSH = 4 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of binary texts: tokens of each, the end counted; the tokens of all texts as places in a list;
    that list of distinct tokens. Tokens are words between ASCII white space, A-Z lower-cased, then the end."""
    # Lower-cased first: of a large string array that was cast from a slice, ascii_lower reads the wrong bytes.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())).cast(pa.large_string()))
    flat = parts.flatten().dictionary_encode()
    words, places = byte_list(flat.dictionary), flat.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    if b"" in words:  # before leading and after trailing white space
        real = places != words.index(b"")
        places, row = places[real], row[real]
    sizes = np.bincount(row, minlength=len(texts)) + 1
    out, end = np.empty(int(sizes.sum()), np.int64), np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[end] = False
    out[end], out[inner] = len(words), places
    return sizes, out, [*words, END]


def byte_list(words: pa.Array) -> list[bytes]:
    """The values of a large string array, without a Python step for each in the Arrow library."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset).tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def _power(n: int) -> int:
    return max(LEAST_SHARDS, 1 << max(0, n - 1).bit_length())


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """A multiplicative hash of a pair's key, whose top bits pick the shard."""
    mixed = (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64)


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by shard, stable, and where each shard starts and the last one stops."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _save(folder: str, name: str, data: bytes) -> str:
    """Writes under a name of its own, then renames: no half file ever has a final name."""
    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{inner}/_{own}") as out:
        out.write(data)
    store.move(f"{inner}/_{own}", f"{inner}/{own}.ef")
    return f"{folder}/{own}.ef"


def _open(path: str):
    """Maps a file of the shared folder into memory; a store that has no local path is read."""
    store, inner = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return load(np.memmap(inner, np.uint8, "r"))
    with store.open_input_file(inner) as source:
        return load(np.frombuffer(source.read(), np.uint8))


class Model:
    """Where the shards are, and the totals: sent to every task, a path for each shard."""

    def __init__(self, seed: int, total: int, distinct: int, vocabulary: list[str], offsets: list[int], pairs: list[str | None], end_id: int, strengths: tuple[float, float]):
        self.seed, self.total, self.distinct, self.strengths = seed, total, distinct, strengths
        self.vocabulary, self.offsets, self.pairs, self.end_id = vocabulary, offsets, pairs, end_id


class Shards(Mapping):
    """Shards by number, opened when they are needed; ``most`` of them stay open."""

    def __init__(self, paths: list[str | None], most: int):
        self.paths, self.most, self.open = paths, most, {}

    def __len__(self) -> int:
        return len(self.paths)

    def __iter__(self):
        return iter(range(len(self.paths)))

    def __getitem__(self, s: int):
        if s not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open)))  # the one that has been open for longest
            self.open[s] = self.paths[s] and _open(self.paths[s])
        return self.open[s]


class Reader:
    """Looks words and pairs up, a batch at a time and shard by shard, so that each shard that a batch
    needs is opened once; few are open at a time, however many there are."""

    def __init__(self, model: Model, most: int = OPEN_SHARDS):
        self.m = model
        self.words, self.tries = Shards(model.vocabulary, most), Shards(model.pairs, most)
        self.bits = len(model.vocabulary).bit_length() - 1

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 where unknown) and counts of words."""
        hashes = np.fromiter((word_hash(w, self.m.seed) for w in words), np.uint64, len(words))
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        order, cuts = _dealt(shard, len(self.words))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            sequences, arrays, _ = self.words[s]
            own = order[cuts[s] : cuts[s + 1]]
            at = sequences["hashes"].search(hashes[own])
            hit = at >= 0
            ids[own[hit]] = self.m.offsets[s] + at[hit]
            counts[own[hit]] = arrays["counts"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers."""
        out = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        cuts = np.searchsorted(ids[order], [*self.m.offsets, self.m.distinct])
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own, arrays = order[cuts[s] : cuts[s + 1]], self.words[s][1]
            out[own] = arrays["counts"][ids[own] - self.m.offsets[s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.m.total + self.m.distinct + 1)

    def grams(self, keys: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs (context << 32 | word), each with the number of the word after it (-1 for none or unknown):
        log10 of P2 of the pair, NaN where not seen; the log10 weight of P2 after the pair; and the first
        term of P3 of the word after it, 0 where not seen."""
        second, weight, third = np.full(len(keys), np.nan), np.zeros(len(keys)), np.zeros(len(keys))
        order, cuts = _dealt(_pair_shard(keys, len(self.tries)), len(self.tries))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own, trie = order[cuts[s] : cuts[s + 1]], self.tries[s]
            if trie is None:
                continue
            sequences, arrays, meta = trie
            context = sequences["contexts"].search(keys[own] >> np.uint64(32))
            own, at = _under(sequences, "pointers", "successors", meta["universe"], own, context, keys[own] & np.uint64(0xFFFFFFFF))
            second[own] = arrays["codes"][at] * -STEP
            if "thirds" in sequences:
                weight[own] = arrays["weights"][at] * -STEP
                follows = after[own] >= 0
                own, at = own[follows], at[follows]
                own, at = _under(sequences, "followers", "thirds", meta["universe"], own, at, after[own].astype(np.uint64))
                third[own] = np.power(10.0, arrays["terms"][at] * -STEP)
        return second, weight, third

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: tokens, known tokens, base score and the model's score."""
        sizes, at, words = tokens(texts)
        ids, counts = self.find(words)
        base, strength = np.log10(self.unigram(counts))[at], self.m.strengths[0]
        starts = np.cumsum(sizes) - sizes
        word, count = ids[at], counts[at]
        before, context = np.empty_like(word), np.empty_like(count)
        before[1:], context[1:] = word[:-1], count[:-1]
        before[starts], context[starts] = self.m.end_id, counts[-1]
        value = np.log10(strength / (context + strength)) + base
        both = np.flatnonzero((before >= 0) & (word >= 0))
        after = np.append(word[1:], -1)
        after[starts + sizes - 1] = -1
        keys = before[both].astype(np.uint64) << np.uint64(32) | word[both].astype(np.uint64)
        second, weight, third = self.grams(keys, after[both])
        value[both] = np.where(np.isnan(second), value[both], second)
        first = np.zeros(len(value) + 1, bool)
        first[starts], first[-1] = True, True
        inner = np.flatnonzero(((weight < 0) | (third > 0)) & ~first[both + 1])  # of these pairs more than P2 is known
        to = both[inner] + 1
        value[to] = np.log10(third[inner] + np.power(10.0, weight[inner] + value[to]))
        return sizes, *(np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, value))


def _under(sequences: dict, pointers: str, successors: str, universe: int, own: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ``own`` with a place in one level (-1 for none) and a word: those whose word is among the
    successors of that place, and where it is there."""
    there = place >= 0
    own, place, word = own[there], place[there], word[there]
    if not len(own):
        return own, place
    bounds = sequences[pointers].get(np.concatenate([place, place + 1])).astype(np.int64)
    first, stop = bounds[: len(place)], bounds[len(place) :]
    at = sequences[successors].search(place.astype(np.uint64) * np.uint64(universe) + word, first, stop)
    return own[at >= 0], at[at >= 0]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            _, at, words = tokens(part.column("text"))
            counts.update({w: n for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True) if n})
            if len(counts) > 300_000:
                yield from out()
                counts.clear()
    if counts:
        yield from out()


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def learn(docs: DataFrame, train: Column, strength: float = STRENGTH, text_col: str = "text", order: int = 3, strength_3: float = STRENGTH_3) -> Model:
    """Counts all texts for which ``train`` holds and writes the shards into the shared folder; ``order``
    is 3, or 2 for a model of pairs alone.

    The driver gets the totals and a path for each shard. Null texts count as empty ones: an end
    token. With nothing to learn from, every token is unknown and scores as one of one.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    ship(docs.sparkSession)
    folder = new_folder(docs.sparkSession, "lm")
    texts = _texts(docs.filter(train), text_col)
    words = stored(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct, top = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    shards, seed = _power(-(-distinct // WORDS_PER_SHARD)), 0  # the functions below use the seed of the moment
    width = "<u4" if top < 1 << 32 else "<u8"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([word_hash(w, seed) for w in batch.column("word").to_pylist()], np.uint64)
            shard = own >> np.uint64(64 - (shards.bit_length() - 1))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array((own ^ np.uint64(1 << 63)).view(np.int64)), batch.column("n")], names=["shard", "h", "n"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            own = pa.Table.from_batches(rows)
            h = own["h"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            order = np.argsort(h, kind="stable")
            if (h[order][1:] == h[order][:-1]).any():
                yield _row(shard, None, len(h))  # two words share a hash: another seed is tried
                continue
            data = dump({"hashes": EliasFano.build(h[order])}, {"counts": own["n"].to_numpy()[order].astype(width)}, {})
            yield _row(shard, _save(folder, f"words-{shard:06d}", data), len(h))

    for seed in range(100):
        dealt = words.mapInArrow(hashed, "shard int, h long, n long").repartition(shards, F.col("shard")).sortWithinPartitions("shard")
        found = stored(dealt.mapInArrow(write_words, "shard int, path string, n long"), "words-manifest").collect()  # one row for each shard
        if all(r.path is not None for r in found):
            break
    paths, sizes = dict((r.shard, r.path) for r in found), dict((r.shard, r.n) for r in found)
    empty = _save(folder, "words-none", dump({"hashes": EliasFano.build(np.zeros(0, np.uint64))}, {"counts": np.zeros(0, width)}, {}))
    vocabulary = [paths.get(s, empty) for s in range(shards)]
    offsets = [0, *np.cumsum([sizes.get(s, 0) for s in range(shards)]).tolist()][:-1]
    if distinct >= 1 << 31:
        raise ValueError("more than 2^31 distinct words do not fit a pair's key")
    model = Model(seed, total, distinct, vocabulary, offsets, [], -1, (strength, strength_3))
    if distinct:
        model.end_id = int(Reader(model).find([END])[0][0])
    parts = _power(-(-total // TOKENS_PER_SHARD))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size, zip_ = Reader(model), [], 0, zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            grams = _counted(np.concatenate(held), model.end_id, order)
            held.clear()
            rows = [(s, zip_.compress(_packed(own))) for s, own in _shards_of(grams, parts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "grams"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, at, words = tokens(part.column("text"))
                held.append(reader.find(words)[0][at].astype(np.uint32))
                size += len(at)
                if size >= FLUSH:
                    yield out()
                    size = 0
        if held:
            yield out()

    def write_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, unzip = None, zstandard.ZstdDecompressor()
        for shard, rows in _by_shard(batches):
            reader = reader or Reader(model)
            some, size = [], 0
            for x in (x for b in rows for x in b.column("grams")):
                some.append(_unpacked(unzip.decompress(x.as_py())))
                size += len(some[-1][0]) + len(some[-1][3])
                if size > 2 * FLUSH:  # what a hot pair's entries come to is merged in parts
                    some = [_merged(some)]
                    size = 0
            keys, n, followers, last, n_last = _merged(some)
            del some
            context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            contexts, first, at = np.unique(context, return_index=True, return_inverse=True)
            prior = strength * reader.unigram(reader.counts(word.astype(np.int64)))
            sequences = {
                "contexts": EliasFano.build(contexts),
                "pointers": EliasFano.build(np.append(first, len(keys)).astype(np.uint64)),
                "successors": EliasFano.build(at.astype(np.uint64) * np.uint64(model.distinct) + word),
            }
            arrays = {"codes": _codes((n + prior) / (reader.counts(contexts.astype(np.int64))[at] + strength))}
            if order == 3:
                place = np.repeat(np.arange(len(keys)), followers)
                sequences["followers"] = EliasFano.build(np.concatenate([[0], np.cumsum(followers)]).astype(np.uint64))
                sequences["thirds"] = EliasFano.build(place.astype(np.uint64) * np.uint64(model.distinct) + last)
                arrays |= {"weights": _codes(strength_3 / (n + strength_3)), "terms": _codes(n_last / (n[place] + strength_3))}
            yield _row(shard, _save(folder, f"grams-{shard:06d}", dump(sequences, arrays, {"universe": model.distinct})), len(keys))

    pieces = texts.mapInArrow(count_grams, "shard int, grams binary").repartition(parts, F.col("shard")).sortWithinPartitions("shard")
    found = stored(pieces.mapInArrow(write_grams, "shard int, path string, n long"), "grams-manifest").collect() if distinct else []
    by_shard = {r.shard: r.path for r in found}
    model.pairs = [by_shard.get(s) for s in range(parts)]
    return model


def _row(shard: int, path: str | None, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path], pa.string()), pa.array([n], pa.int64())], names=["shard", "path", "n"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The batches of each shard; they come in order of shards."""
    now, held = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if shard[low] != now:
                if held:
                    yield now, held
                now, held = int(shard[low]), []
            held.append(batch.slice(low, high - low))
    if held:
        yield now, held


def _codes(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log10(p) / -STEP), 65535).astype("<u2")


#: Ascending pairs, their counts, how many words follow each; these words, ascending after each pair, and their counts.
Grams = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _counted(ids: np.ndarray, end: int, order: int) -> Grams:
    """The pairs and triples of whole texts, one after the other, each with its end."""
    ids = ids.astype(np.uint64)
    before = np.concatenate([[np.uint64(end)], ids[:-1]])
    keys, which, n = np.unique(before << np.uint64(32) | ids, return_inverse=True, return_counts=True)
    later = np.flatnonzero(before != end) if order == 3 else np.zeros(0, np.int64)
    triples = which[later - 1].astype(np.uint64) << np.uint64(32) | ids[later]
    triples.sort()
    return _grouped(keys, n, triples, None)


def _grouped(keys: np.ndarray, n: np.ndarray, triples: np.ndarray, counts: np.ndarray | None) -> Grams:
    """Adds up equal ones of ascending triples (place of the pair << 32 | word)."""
    first = np.flatnonzero(np.diff(triples, prepend=~triples[:1]))
    own = np.diff(first, append=len(triples)) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    triples = triples[first]
    return keys, n, np.bincount((triples >> np.uint64(32)).astype(np.int64), minlength=len(keys)), triples & np.uint64(0xFFFFFFFF), own


def _merged(some: list[Grams]) -> Grams:
    if len(some) == 1:
        return some[0]
    n, followers, last, n_last = (np.concatenate([x[i] for x in some]) for i in (1, 2, 3, 4))
    keys, which = np.unique(np.concatenate([x[0] for x in some]), return_inverse=True)
    triples = np.repeat(which, followers).astype(np.uint64) << np.uint64(32) | last
    order = np.argsort(triples, kind="stable")
    return _grouped(keys, np.bincount(which, n, len(keys)).astype(np.int64), triples[order], n_last[order])


def _shards_of(grams: Grams, shards: int) -> Iterator[tuple[int, Grams]]:
    keys, n, followers, last, n_last = grams
    shard = _pair_shard(keys, shards)
    order, cuts = _dealt(shard, shards)
    order_3, cuts_3 = _dealt(np.repeat(shard, followers), shards)
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own, own_3 = order[cuts[s] : cuts[s + 1]], order_3[cuts_3[s] : cuts_3[s + 1]]
        yield s, (keys[own], n[own], followers[own], last[own_3], n_last[own_3])


def _packed(grams: Grams) -> bytes:
    """Pairs as differences, then the other numbers, byte planes apart: small once compressed."""
    keys, n, followers, last, n_last = grams
    planes = [_planes(np.diff(keys, prepend=np.uint64(0)), 8), *(_planes(x, 4) for x in (n, followers, last, n_last))]
    return b"".join([len(keys).to_bytes(8, "little"), len(last).to_bytes(8, "little"), *planes])


def _planes(values: np.ndarray, width: int) -> bytes:
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(data: bytes) -> Grams:
    pairs, triples = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    out, at = [], 16
    for size, width in ((pairs, 8), (pairs, 4), (pairs, 4), (triples, 4), (triples, 4)):
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += size * width
    return np.cumsum(out[0], dtype=np.uint64), *(x.astype(np.int64) for x in out[1:3]), out[3].astype(np.uint64), out[4].astype(np.int64)


_READERS: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text and its end. Null texts count as empty ones;
    identifiers pass through. Batches of a few MB are looked up shard by shard in mapped files.
    """
    ship(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a path for each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(sent.value)
        reader = _READERS[key]
        for batch in batches:
            for part in slices(batch, "text"):
                n, known, base, own = reader.score(part.column("text"))
                columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([sent.value.total] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
