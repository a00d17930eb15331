"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood
is the sum over all ways of writing it as pieces; a forward pass gets that sum in one step for
each match of a piece. The probabilities are learned by expectation maximisation with the matching
backward pass. A text's likelihood is the product over its words.

Many words are summed at a time: their letters stand in columns (first letters, second letters, and
so on), so a step of the forward pass takes one column for all words. Every few columns the sums
are scaled and the logarithm of the scale is kept, so words of any length, in any script, have a
finite logarithm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import check_names, ship, slices

#: Documents of each language that the probabilities are learned from, at most (about).
DOCS_PER_LANGUAGE = 400
ROUNDS = 3
SMOOTHING = 0.05
#: Words whose likelihoods a Python worker keeps; this changes speed only.
KEPT_WORDS = 150_000
#: Characters of words that one lattice holds, about.
LATTICE = 1 << 18
#: Columns between two scalings: so few that sums of the least probable bytes do not vanish between them.
SCALED = 4
MARK = "▁"  # stands before each word, as in the vocabulary


class Table:
    """Numbers by keys (both from 0 on), many lookups at a time, by open addressing; -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            going = ~hit & (found >= 0)
            left, slot = left[going], slot[going]
        return out


class Pieces:
    """A vocabulary as a trie over characters: where a character leads, and which piece ends there."""

    def __init__(self, names: list[str], byte_ids: dict[int, int]):
        self.size, self.byte_ids = len(names), byte_ids
        node: dict[int, int] = {}
        ends = [-1]
        for i, name in enumerate(names):
            at = 0
            for c in name:
                key = at << 21 | ord(c)
                at = node.get(key, 0)
                if not at:
                    at = node[key] = len(ends)
                    ends.append(-1)
            if at:
                ends[at] = i
        self.longest = max(map(len, names), default=0)
        self.steps = Table(np.fromiter(node, np.int64, len(node)), np.fromiter(node.values(), np.int64, len(node)))
        self.ends = np.array([*ends, -1])  # the last one stands for no node

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a sentencepiece model: ordinary pieces, and byte pieces for characters without one."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names, byte_ids = [], {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            names.append(name if plain else "")
        return cls(names, byte_ids)


class Lattice:
    """All matches of pieces in many words.

    Words go by length, longest first, so the words that reach a column are the first ones. Sums have
    a place for each column from 0 (nothing read) to the longest word's end: that of word w
    in column j is ``at[j] + w``. For each length of a piece, ``hits`` has the matches in order of the
    columns they start in: their words, ids, and where each column begins. A character that is no
    piece counts as its bytes: an id behind the vocabulary, listed in ``extra``.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        marked = [MARK + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        self.order = np.argsort(-sizes, kind="stable")
        self.n, self.sizes, self.size = len(words), sizes[self.order], pieces.size
        self.longest = int(self.sizes.max(initial=0))
        self.alive = self.n - np.searchsorted(self.sizes[::-1], np.arange(self.longest + 1))  # words that reach each column
        self.at = np.append(0, np.cumsum(self.alive))
        text = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = (np.cumsum(sizes) - sizes)[self.order]
        start = np.append(0, np.cumsum(self.alive[1:]))  # characters before each column
        column = np.repeat(np.arange(self.longest), self.alive[1:])
        word = np.arange(len(column)) - start[column]
        char = text[first[word] + column]
        node = pieces.steps.get(char)
        ids = pieces.ends[node]
        rare = np.flatnonzero(ids < 0)
        kinds, which = np.unique(char[rare], return_inverse=True)
        ids[rare] = pieces.size + which
        self.extra = [np.array([pieces.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]) for c in kinds.tolist()]
        self.hits = [(word, ids, start)]
        own = np.flatnonzero(node >= 0)
        node = node[own]
        for more in range(1, pieces.longest):
            there = np.flatnonzero(column[own] + more < self.sizes[word[own]])
            own = own[there]
            node = pieces.steps.get(node[there].astype(np.int64) << 21 | char[start[column[own] + more] + word[own]])
            there = np.flatnonzero(node >= 0)
            own, node = own[there], node[there]
            full = np.flatnonzero(pieces.ends[node] >= 0)
            at = own[full]
            self.hits.append((word[at], pieces.ends[node[full]], np.searchsorted(column[at], np.arange(self.longest + 1))))
            if not len(own):
                break

    def backwards(self) -> Lattice:
        """The same matches in the words read from their ends."""
        out = object.__new__(Lattice)
        out.__dict__.update(self.__dict__)
        out.hits = []
        for k, (word, ids, start) in enumerate(self.hits, 1):
            column = self.sizes[word] - k - np.repeat(np.arange(self.longest), np.diff(start))
            order = np.argsort(column, kind="stable")
            out.hits.append((word[order], ids[order], np.searchsorted(column[order], np.arange(self.longest + 1))))
        return out

    def weights(self, p: np.ndarray) -> np.ndarray:
        """Probabilities by id, the extra ids included: id, language; from language, piece."""
        return np.concatenate([p, *(p[:, own].prod(axis=1, keepdims=True) for own in self.extra)], axis=1).T.copy()

    def forward(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of each prefix (place, language), scaled, and the logarithms
        of what they were divided by."""
        sums = np.zeros((self.at[-1], weights.shape[1]))
        logs = np.zeros_like(sums)
        sums[: self.n] = 1
        for j in range(1, self.longest + 1):
            here, many = self.at[j], self.alive[j]
            for k, (word, ids, start) in enumerate(self.hits, 1):
                if k > j:
                    break
                low, high = start[j - k], start[j - k + 1]
                if low < high:
                    own = word[low:high]
                    sums[here + own] += sums.take(self.at[j - k] + own, axis=0) * weights.take(ids[low:high], axis=0)
            if j % SCALED == 0:
                scale = np.maximum(sums[here : here + many], 1e-300)
                for i in range(max(0, j - len(self.hits)), j + 1):
                    back = slice(self.at[i], self.at[i] + many)
                    sums[back] = np.minimum(sums[back] / scale, 1e300)
                    logs[back] += np.log(scale)
            # A later column goes on from the scale of this one.
            if j < self.longest:
                after = slice(self.at[j + 1], self.at[j + 1] + self.alive[j + 1])
                logs[after] = logs[here : here + self.alive[j + 1]]
        return sums, logs

    def log_likelihood(self, weights: np.ndarray) -> np.ndarray:
        """Logarithms of the words' likelihoods, finite: word (in the order given), language."""
        sums, logs = self.forward(weights)
        end = self.at[self.sizes] + np.arange(self.n)
        out = np.empty((self.n, weights.shape[1]))
        out[self.order] = np.log(np.maximum(sums[end], 1e-300)) + logs[end]
        return out

    def expected(self, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece of the vocabulary, by forward and backward sums; weights of one
        language, and how often each word (in the order given) occurs."""
        with np.errstate(divide="ignore"):
            ahead, behind = (np.log(sums[:, 0]) + logs[:, 0] for sums, logs in (x.forward(weights) for x in (self, self.backwards())))
            chance = np.log(weights[:, 0])
        whole = ahead[self.at[self.sizes] + np.arange(self.n)]
        times, uses = counts[self.order], np.zeros(len(weights))
        for k, (word, ids, start) in enumerate(self.hits, 1):
            column = np.repeat(np.arange(self.longest), np.diff(start))
            share = ahead[self.at[column] + word] + chance[ids] + behind[self.at[self.sizes[word] - column - k] + word] - whole[word]
            uses += np.bincount(ids, np.exp(np.minimum(share, 0)) * times[word], len(weights))
        for own, more in zip(self.extra, uses[self.size :], strict=True):
            np.add.at(uses, own, more)
        return uses[: self.size]


def lattices(pieces: Pieces, words: list[str]) -> Iterator[tuple[Lattice, slice]]:
    """Words in lattices of bounded size; a longer word has one of its own."""
    first, held = 0, 0
    for i, word in enumerate(words):
        if held and held + len(word) > LATTICE:
            yield Lattice(pieces, words[first:i]), slice(first, i)
            first, held = i, 0
        held += len(word) + 1
    if held:
        yield Lattice(pieces, words[first:]), slice(first, len(words))


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, lower-cased, between white space: where each text's begin (and the end of
    all), the number of each word, and the distinct words (an empty one may be among them)."""
    found = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    code = found.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return offsets, code.indices.to_numpy(zero_copy_only=False), code.dictionary


class Model:
    """Piece probabilities of each language."""

    def __init__(self, pieces: Pieces, languages: list[str], p: np.ndarray, prior: np.ndarray):
        if not (np.isfinite(p).all() and (p > 0).all()):
            raise ValueError("piece probabilities must be positive")
        self.pieces, self.languages, self.p, self.prior = pieces, languages, p, prior
        self.row: dict[str, int] = {"": 0}
        self.logs = np.zeros((1, len(languages)))

    @classmethod
    def learn(cls, pieces: Pieces, counts: dict[str, dict[str, int]], prior: dict[str, float]) -> Model:
        languages = sorted(counts)
        p = np.full((len(languages), pieces.size), 1 / pieces.size)
        for k, language in enumerate(languages):
            words = [w for w in counts[language] if w]
            times = np.array([counts[language][w] for w in words], float)
            for _ in range(ROUNDS if words else 0):
                uses = np.full(pieces.size, SMOOTHING)
                for lattice, own in lattices(pieces, words):
                    uses += lattice.expected(lattice.weights(p[k : k + 1]), times[own])
                p[k] = uses / uses.sum()
        return cls(pieces, languages, p, np.array([prior[x] for x in languages]))

    def _rows(self, words: list[str]) -> np.ndarray:
        """Where each distinct word's log likelihoods are; adds those of words not met before."""
        if len(self.row) + len(words) > KEPT_WORDS:
            self.row, self.logs = {"": 0}, self.logs[:1]
        new = [w for w in words if w not in self.row]
        rows = [self.logs]
        for lattice, _ in lattices(self.pieces, new):
            rows.append(lattice.log_likelihood(lattice.weights(self.p)))
        self.row.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate(rows)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and its posterior probability; und and 0 where there is no letter. A text without a
        word still has one empty word, so no sum is empty."""
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        offsets, words, distinct = split(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        rows = self._rows(distinct.to_pylist())
        sums = np.stack([np.add.reduceat(own[rows].take(words), offsets[:-1]) for own in self.logs.T], axis=1) if len(texts) else np.zeros((0, len(self.languages)))
        total = sums + np.log(self.prior)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[k] if has else "und" for k, has in zip(best.tolist(), letters, strict=True)]
        return names, np.where(letters, score, 0.0).tolist()


def learn(docs: DataFrame, pieces_path: str, train: Column, per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows of ``docs`` where ``train`` holds and the language is not null.

    About ``per_language`` whole documents of each language are used, picked by a hash of the
    identifier; the share to pick comes from an exact count. What reaches the driver is the
    word counts of these.
    """
    ship(docs.sparkSession)
    labelled = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(None).cast("double")
    for language, count in n.items():
        share = F.when(F.col("lang") == language, min(1.0, per_language / count)).otherwise(share)
    picked = labelled.filter(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) < share * (1 << 30)) if n else labelled.limit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for language in pc.unique(part.column("lang")).to_pylist():
                    _, words, distinct = split(part.column("text").filter(pc.equal(part.column("lang"), language)))
                    times = np.bincount(words, minlength=len(distinct))
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(distinct), pa.string()), distinct.cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {language: {} for language in n}
    words = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = words.toArrow()
    for language, word, times in zip(got["lang"].to_pylist(), got["word"].to_pylist(), got["n"].to_pylist(), strict=True):
        counts[language][word] = times
    total = sum(n.values())
    return Model.learn(Pieces.load(pieces_path), counts, {x: c / total for x, c in n.items()})


_SCORERS: dict[str, Model] = {}


def _scored(docs: DataFrame, model: Model, pieces_path: str, text_col: str, names: tuple[str, str]) -> DataFrame:
    """All columns of ``docs``, the language and its posterior probability."""
    check_names(docs, names)
    ship(docs.sparkSession)
    # The probabilities have a fixed size: languages times pieces of the vocabulary.
    sent, key = docs.sparkSession.sparkContext.broadcast((model.languages, model.p, model.prior)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Model(Pieces.load(pieces_path), *sent.value)
        own = _SCORERS[key]
        for batch in batches:
            for part in slices(batch, text_col):
                found, scores = own.predict(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, *names])

    schema = StructType(list(docs.schema.fields)).add(names[0], "string").add(names[1], "double")
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (posterior probability of the language).

    Null texts, and texts without a letter, are ``und`` with score 0. Only the text is read, with
    whatever identifier comes along (null and repeated ones too). Without any learned
    language everything is ``und``. Words of any length and script have a finite score.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _scored(whole, model, pieces_path, "text", ("lang_pred", "score")).drop("text")


def keep_identified(docs: DataFrame, model: Model, pieces_path: str, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with at least that posterior."""
    names = ("_lang_pred", "_lang_score")
    found = _scored(docs, model, pieces_path, text_col, names)
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= least)).drop(*names)
