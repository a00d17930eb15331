"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A text is cut into windows of whole words, each window is compressed with either dictionary, and the bytes
that the toxic one saves are its distance. How many windows save how much, by thresholds whose weights
are calibrated on labelled documents that the dictionaries have not seen, gives the text's score.

Toxic documents are mostly ordinary text. So the toxic dictionary holds the fragments of words that are
significantly more frequent in toxic documents (a likelihood-ratio test over byte n-grams, where an
n-gram counts once for each context, so that copies of a document count once), the most frequent nearest
its end, where they are cheapest; and it continues the ordinary dictionary, which the library trains: what
both know costs the same and cancels. (The library's trainer cuts through such fragments, and
dictionaries without a common part differ more by chance than by class.)
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotated, check_names, ship
from .ngram_lm import tokens

#: Labelled documents of each class, and bytes of their text, that the classifier is fitted to, at most (about).
SAMPLE, SAMPLE_BYTES = 8_000, 12_000_000
#: Passages that sampled documents are dealt in, in words.
PASSAGE = 400
#: Bytes of a window, at least (but for a text's last one); bytes of the ordinary dictionary; fragments that the toxic one adds.
WINDOW, ORDINARY_BYTES, FRAGMENTS = 64, 16_384, 400
LEVEL = 3
#: Lengths of n-grams (eight bytes fill a number), least contexts, least likelihood ratio, least ratio of the rates.
GRAMS, LEAST_CONTEXTS, LEAST_G2, LEAST_RATE = (5, 6, 7, 8), 4, 30.0, 5.0
#: Bytes saved from which a window counts.
THRESHOLDS = (1, 2, 3, 4)
N_FEATURES = 2 * len(THRESHOLDS) + 4


def windows(text: bytes) -> list[bytes]:
    """A text, A-Z lower-cased, as windows of whole words between single spaces; one of white space
    alone if there are none."""
    out, held, size = [], [], 0
    for word in text.lower().split():
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" %b " % b" ".join(held))
            held, size = [], 0
    if held or not out:
        out.append(b" %b " % b" ".join(held))
    return out


class Dictionaries:
    """The two dictionaries, and the weights of the calibrated thresholds."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean=None, scale=None, weights=None):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weights = mean, scale, weights
        self._open = None

    def __getstate__(self):
        return {**vars(self), "_open": None}  # a compressor can't be sent

    def saved(self, text: str | None) -> np.ndarray:
        """Bytes that each window of a text saves with the toxic dictionary."""
        if self._open is None:
            self._open = tuple(_compressor(d) for d in (self.ordinary, self.toxic))
        ordinary, toxic = (c.compress for c in self._open)
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows((text or "").encode())])

    def features(self, text: str | None) -> list[float]:
        saved = self.saved(text)
        over = [(saved >= t).sum() for t in THRESHOLDS]
        return [*np.log1p(over).tolist(), *(n / len(saved) for n in over), float(saved.mean()), float(np.maximum(saved - 1, 0).mean()), float(saved.max()), float(np.log(len(saved)))]

    def score(self, text: str | None) -> float:
        """0 where there was nothing to learn from."""
        if self.weights is None:
            return 0.0
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50))))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary from the library's trainer; of samples too few for it, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _contexts(texts: list[bytes]) -> dict[bytes, int]:
    """How many distinct contexts (the words before and after) each word of these texts has."""
    sizes, at, words = tokens(pa.array(texts, pa.binary()))
    if not len(at):
        return {}
    before, after = np.roll(at, 1), np.roll(at, -1)  # texts end in a token of their own
    with np.errstate(over="ignore"):
        key = np.zeros(len(at), np.uint64)
        for part in (before, at, after):
            key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    _, first = np.unique(key, return_index=True)
    counts = np.bincount(at[first], minlength=len(words))
    return {w: int(n) for w, n in zip(words[:-1], counts, strict=False) if n}  # the last is the end


def _grams(contexts: dict[bytes, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words between spaces, packed into numbers, ascending, and how many contexts each has."""
    buffer = np.frombuffer(b"".join(b" %b \0" % w for w in contexts), np.uint8)
    weight = np.repeat(np.fromiter(contexts.values(), np.int64, len(contexts)), [len(w) + 3 for w in contexts])
    if len(buffer) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(buffer) - n + 1
    key, whole = np.zeros(size, np.uint64), np.ones(size, bool)
    for j in range(n):
        byte = buffer[j : j + size]
        key = key << np.uint64(8) | byte
        whole &= byte != 0
    keys, place = np.unique(key[whole], return_inverse=True)
    return keys, np.bincount(place, weights=weight[:size][whole], minlength=len(keys)).astype(np.int64)


def marks(toxic: dict[bytes, int], ordinary: dict[bytes, int]) -> set[bytes]:
    """N-grams that toxic texts have significantly more often than ordinary ones."""
    n1, n0, out = max(1, sum(toxic.values())), max(1, sum(ordinary.values())), set()
    for n in GRAMS:
        keys, a = _grams(toxic, n)
        keys, a = keys[a >= LEAST_CONTEXTS], a[a >= LEAST_CONTEXTS]
        other, counts = _grams(ordinary, n)
        at = np.minimum(np.searchsorted(other, keys), max(0, len(other) - 1))
        b = np.where(other[at] == keys, counts[at], 0) if len(other) else np.zeros(len(keys), np.int64)
        share = (a + b) / (n1 + n0)
        g2 = 2 * (a * np.log(a / (n1 * share)) + np.where(b > 0, b * np.log(np.maximum(b, 1) / (n0 * share)), 0))
        good = (g2 > LEAST_G2) & (a / n1 > LEAST_RATE * (b + 0.5) / n0)
        out |= {int(k).to_bytes(n, "big") for k in keys[good].tolist()}
    return out


def fragments(contexts: dict[bytes, int], known: set[bytes]) -> Counter:
    """The runs of bytes of words, spaces around them included, that marks cover, with their contexts."""
    out: Counter = Counter()
    for word, n in contexts.items():
        own, end, start = b" %b " % word, 0, 0
        for i in range(len(own)):
            longest = max((m for m in GRAMS if own[i : i + m] in known), default=0)
            if longest:
                if i > end:
                    if end > start:
                        out[own[start:end]] += n
                    start = i
                end = max(end, i + longest)
        if end > start:
            out[own[start:end]] += n
    return out


def train(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries | None:
    """Dictionaries of passages of either class; nothing where toxic ones show no marks."""
    own = _contexts(toxic)
    found = fragments(own, marks(own, _contexts(ordinary)))
    if not found:
        return None
    ranked = sorted(found, key=lambda f: (found[f], f))
    base = _trained(ORDINARY_BYTES, [w for t in ordinary for w in windows(t)])
    return Dictionaries(base, base + b"".join(ranked[-FRAGMENTS:]))


def calibrate(found: Dictionaries, x: np.ndarray, toxic: np.ndarray) -> Dictionaries:
    """Weights of the features by logistic regression with a small penalty."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a, y = np.c_[(x - mean) / scale, np.ones(len(x))], toxic.astype(float)
    weights = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -50, 50)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(a.shape[1]), a.T @ (p - y) + weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return Dictionaries(found.ordinary, found.toxic, mean, scale, weights)


def learn(docs: DataFrame, labels: DataFrame, train_on: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Dictionaries:
    """The fitted dictionaries and weights.

    Of each class, about ``sample`` labelled documents for which ``train_on`` (a column over the
    identifier) holds are used, picked by a hash of the identifier at a rate from an exact count; a third of them, by
    another hash, calibrates. Of the texts that the dictionaries are trained on, passages of ``PASSAGE`` words
    are picked in the same way so that about ``sample_bytes`` of each class reach the driver. A document with
    both labels counts as toxic; null labels, identifiers and texts are not used.
    """
    ship(docs.sparkSession)
    marked = labels.filter(train_on & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) == 1).alias("toxic"))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    place = lambda salt, *more: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), *more, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic"), min(1.0, sample / max(1, counts.get(True, 0)))).otherwise(min(1.0, sample / max(1, counts.get(False, 0))))
    # At most about twice ``sample`` identifiers, so they may be broadcast.
    picked = marked.filter(place("sample") < rate).withColumn("calibrates", place("fold") < 1 / 3)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(picked), "doc_id")
    sizes = {r.toxic: r.n for r in whole.filter("not calibrates").groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return Dictionaries(b"", b"")

    def passages(batches):
        for batch in batches:
            rows = []
            for i, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                own = text.encode().split()
                rows += [(i, n, toxic, b" ".join(own[k : k + PASSAGE])) for n, k in enumerate(range(0, len(own), PASSAGE))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["doc_id", "n", "toxic", "passage"])

    cut = whole.filter("not calibrates").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text").mapInArrow(passages, "doc_id string, n int, toxic boolean, passage binary")
    share = F.when(F.col("toxic"), min(1.0, sample_bytes / max(1, sizes[True]))).otherwise(min(1.0, sample_bytes / max(1, sizes[False])))
    got = cut.filter(place("passage", F.col("n")) < share).drop("doc_id", "n").toArrow()
    texts = sorted(zip(got["toxic"].to_pylist(), got["passage"].to_pylist(), strict=True))  # the order in which tasks end must not matter
    del got
    found = train([t for toxic, t in texts if toxic], [t for toxic, t in texts if not toxic])
    if found is None:
        return Dictionaries(b"", b"")
    state = docs.sparkSession.sparkContext.broadcast(found)  # some twenty kilobytes

    def measured(batches):
        for batch in batches:
            own = pa.array([state.value.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), own], names=["toxic", "x"])

    seen = whole.filter("calibrates").select("text", "toxic").mapInArrow(measured, "toxic boolean, x array<double>").toArrow()
    x = np.array(seen["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES)
    toxic = np.array(seen["toxic"].to_pylist(), bool)
    if not toxic.any() or toxic.all():
        return Dictionaries(b"", b"")
    order = np.lexsort((toxic, *x.T))
    return calibrate(found, x[order], toxic[order])


def score(docs: DataFrame, found: Dictionaries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1; higher: toxic likelier) and predicted (1 from 0.5 on).

    Only the text counts, and all of it. Null texts score as empty ones; null and repeated identifiers
    pass through. With no labels of both classes to learn from, or no marks, every score is 0.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    state = docs.sparkSession.sparkContext.broadcast(found)
    scored = annotated(whole, "text", {"score": "double"}, lambda: lambda texts: [(state.value.score(t),) for t in texts]).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, found: Dictionaries, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores less than that; null texts score as empty ones."""
    check_names(docs, ["_toxicity_score"])
    state = docs.sparkSession.sparkContext.broadcast(found)
    scored = annotated(docs, text_col, {"_toxicity_score": "double"}, lambda: lambda texts: [(state.value.score(t),) for t in texts])
    return scored.filter(F.col("_toxicity_score") < most).drop("_toxicity_score")
