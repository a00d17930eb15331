"""Byte-pair encoding by a trie of distinct words.

The encoding of a text is fixed by its last token and the encoding of what stands before it, and
a token may follow another exactly when merging the two tokens' bytes anew gives the two back.
So every prefix of a word has one *last token*: the one among the tokens that end there which may
follow the last token of the prefix before it. Distinct words go into a trie that an executor's
worker keeps between texts, in depth-first order; each node gets its last token from its ancestors'
states once, so what words share at their start is encoded once. The tokens that end at a node come
from an automaton over the vocabulary, whose state a node has too. A word's tokens are then
read off backwards from its node.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .encoding import _BYTE_WORDS, _PLAIN, _WORD_START, byte_alphabet

#: The published word pattern of byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TrieEncoder:
    """Encodes and decodes with a byte-level tokenizer file. ``max_words`` and ``max_nodes`` bound the
    words whose encodings, and the nodes of the trie, are kept between texts; they change speed only."""

    def __init__(self, path: str, max_words: int = 400_000, max_nodes: int = 800_000):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, before = config["model"], config["pre_tokenizer"]
        if model["type"] != "BPE" or config["normalizer"] or config["post_processor"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser and post-processor is needed")
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.ids = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items()}
        self.bytes = {i: word for word, i in self.ids.items()}
        # For each pair of tokens that merges: its rank and what it gives.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
            self.parts.setdefault(self.ids[a + b], (rank, self.ids[a], self.ids[b]))
        # Only tokens that the merges make of their own bytes can occur: those are the automaton's.
        self.specials = {t["content"]: t["id"] for t in config["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in config["added_tokens"]):
            raise ValueError("special tokens must match as they are")
        self.special_bytes = {i: s.encode() for s, i in self.specials.items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.follows: dict[int, bool] = {}
        self._automaton([(word, i) for word, i in self.ids.items() if self._own(i)])
        self.size = {i: len(word) for i, word in self.bytes.items()}
        self.max_words, self.max_nodes = max_words, max_nodes
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.odd: set[bytes] = set()  # words that their tokens do not decode to
        self._forget()

    def _forget(self) -> None:
        """Empties the trie: node 0 is the root; by node: its last token and its automaton state."""
        self.child: dict[int, int] = {}
        self.last, self.state = array("i", [-1]), array("i", [0])

    def _automaton(self, words: list[tuple[bytes, int]]) -> None:
        """States are the prefixes of tokens; for each, the tokens that are suffixes of it, longest first,
        and the state of its longest proper suffix. Steps are found when they are needed."""
        self.goto: dict[int, int] = {}
        own, back, into = [-1], [0], [(0, 0)]
        for word, token in words:
            at = 0
            for b in word:
                step = self.goto.get(at << 8 | b)
                if step is None:
                    step = self.goto[at << 8 | b] = len(own)
                    own.append(-1)
                    back.append(0)
                    into.append((at, b))
                at = step
            own[at] = token
        depth = [0] * len(own)
        for at in range(1, len(own)):
            depth[at] = depth[into[at][0]] + 1
        tree = self.goto.copy()
        self.ends: list[tuple[int, ...]] = [()] * len(own)
        for at in sorted(range(1, len(own)), key=depth.__getitem__):
            before, b = into[at]
            tail = 0
            while before:
                before = back[before]
                if (tail := tree.get(before << 8 | b, 0)):
                    break
            back[at] = tail
            self.ends[at] = ((own[at],) if own[at] >= 0 else ()) + self.ends[tail]
        self.back = back

    def _step(self, state: int, b: int) -> int:
        """The state after one more byte, which is kept."""
        key, found = state << 8 | b, None
        while found is None:
            found = self.goto.get(state << 8 | b)
            if found is None:
                if not state:
                    found = 0
                else:
                    state = self.back[state]
        self.goto[key] = found
        return found

    def _merged(self, tokens: list[int]) -> list[int]:
        """Plain merging, lowest rank first and leftmost first; for single tokens and pairs only."""
        while len(tokens) > 1:
            rank, at = min((self.merge.get((a, b), (1 << 60,))[0], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)))
            if rank == 1 << 60:
                break
            tokens = [*tokens[:at], self.merge[tokens[at], tokens[at + 1]][1], *tokens[at + 2 :]]
        return tokens

    def _own(self, token: int) -> bool:
        word = self.bytes[token]
        return len(word) == 1 or (token in self.parts and self._merged([self.ids[word[i : i + 1]] for i in range(len(word))]) == [token])

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, merged anew, give just these two.

        The history is run backwards: the later of the two merges that made the parts at the
        border is undone, again and again. The two do not stay apart if at some moment the parts
        at the border would have merged before the next merge that changed one of them; of two
        equal merges the left one comes first.
        """
        found = self.follows.get(a << 32 | b)
        if found is None:
            merge, parts, single = self.merge, self.parts, (-1, 0, 0)
            left, right, until, found = a, b, 1 << 60, True
            while True:
                if (made := merge.get((left, right))) is not None and made[0] < until:
                    found = False
                    break
                l, r = parts.get(left, single), parts.get(right, single)
                if l[0] > r[0]:
                    until, left = l[0], l[2]
                elif r[0] >= 0:
                    until, right = r[0] + 1, r[1]
                else:
                    break
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            self.follows[a << 32 | b] = found
        return found

    def learn(self, words: set[bytes]) -> None:
        """Encodes distinct words by a depth-first walk: sorted words are the leaves in that order, and
        lists hold the path from the root to the present node. What is new in a word gets nodes;
        these stay for the words of later texts."""
        if len(self.last) > self.max_nodes:
            self._forget()
        child, last, state, goto, ends, size = self.child, self.last, self.state, self.goto, self.ends, self.size
        follow, cached, token_bytes, known = self._may_follow, self.follows, self.bytes, self.known
        fresh = len(last)  # nodes from here on have no child but on the path
        nodes, lasts, states, before = [0], [-1], [0], b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            before = word
            del nodes[shared + 1 :], lasts[shared + 1 :], states[shared + 1 :]
            node, now, depth = nodes[shared], states[shared], shared
            for b in word[shared:]:
                depth += 1
                key = node << 8 | b
                node = child.get(key) if node < fresh else None
                if node is not None:
                    token, now = last[node], state[node]
                else:
                    step = goto.get(now << 8 | b)
                    now = self._step(now, b) if step is None else step
                    for token in ends[now]:
                        start = depth - size[token]
                        if not start:
                            break
                        fits = cached.get(lasts[start] << 32 | token)
                        if fits or (fits is None and follow(lasts[start], token)):
                            break
                    else:
                        raise ValueError("a byte is not in the vocabulary")
                    node = child[key] = len(last)
                    last.append(token)
                    state.append(now)
                nodes.append(node)
                lasts.append(token)
                states.append(now)
            tokens = []
            while depth:
                token = lasts[depth]
                tokens.append(token)
                depth -= size[token]
            tokens.reverse()
            known[word] = tuple(tokens)
            if b"".join([token_bytes[t] for t in tokens]) != word:
                self.odd.add(word)

    def pieces(self, text: str) -> list[list[str] | str]:
        """A text as runs of words, and special tokens as they are."""
        if self.special_cut is None:
            return [self.words(text)]
        if not any(s in text for s in self.specials):
            return [self.words(text)]
        return [x if i % 2 else self.words(x) for i, x in enumerate(self.special_cut.split(text))]

    @staticmethod
    def words(text: str) -> list[str]:
        return _BYTE_WORDS.findall(text) if _PLAIN.match(text) else WORDS.findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            if isinstance(piece, str):
                out.append(self.specials[piece])
                continue
            own = [w.encode() for w in piece]
            if new := {w for w in own if w not in self.known}:
                self.learn(new)
            for w in own:
                out += self.known[w]
        if len(self.known) > self.max_words:
            self.known.clear()
            self.odd.clear()
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.bytes[i] if i in self.bytes else self.special_bytes[i] for i in ids)

    def decode(self, ids) -> str:
        """As the library decodes with special tokens kept: bytes joined, then read as UTF-8 with
        replacement characters for what is not."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


#: A space before other white space or the end, in UTF-8: there a word need not start at the space.
_OPEN_BYTES = re.compile(rb" (?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")


class BatchEncoder:
    """Encodes a batch of texts (in UTF-8) at a time: the distinct pieces that it has not seen yet give
    the distinct words, these go through one trie, and each text is then joined from pieces.

    A text is cut at places where a word always starts: before a space that belongs to a word. All
    pieces but the first are kept without that space.
    """

    def __init__(self, path: str, max_pieces: int = 400_000):
        self.trie = TrieEncoder(path)
        self.max_pieces = max_pieces
        self.text: dict[bytes, bytes] = {}  # decimal ids of a piece, each with a comma before
        self.head: dict[bytes, bytes] = {}  # the same for what stands before a text's first piece
        self.odd: set[bytes] = set()  # pieces, and heads behind a space, that do not decode to themselves
        self.decimal = {i: b",%d" % i for i in [*self.trie.bytes, *self.trie.special_bytes]}
        self.special = re.compile(b"|".join(map(re.escape, map(str.encode, self.trie.specials)))) if self.trie.specials else None

    def _add(self, pieces: set[bytes]) -> None:
        trie, single, several = self.trie, [], {}
        for p in pieces:
            if p.isalpha():
                single.append(p)
            else:
                several[p] = [w.encode() for w in TrieEncoder.words(" " + p.decode())]
        if len(trie.known) > trie.max_words:
            trie.known.clear()
            trie.odd.clear()
        known, odd, text, decimal = trie.known, trie.odd, self.text, self.decimal
        new = {b" " + p for p in single}
        new.update(*several.values())
        trie.learn(new.difference(known))
        for piece in single:
            text[piece] = b"".join([decimal[i] for i in known[b" " + piece]])
        for piece, own in several.items():
            text[piece] = b"".join([decimal[i] for w in own for i in known[w]])
        if odd:
            self.odd.update(p for p in single if b" " + p in odd)
            self.odd.update(p for p, own in several.items() if not odd.isdisjoint(own))

    def digests(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """For each text: tokens, SHA-256 of its decimal ids joined by commas, SHA-256 of the
        text that its ids decode to. Words are decoded when they are encoded; a text all of whose
        words decode to themselves decodes to itself."""
        if len(self.text) + len(self.head) > self.max_pieces:
            for kept in (self.text, self.head, self.odd):
                kept.clear()
        cut, heads = [], []
        for text in texts:
            if self.special and self.special.search(text):
                heads.append(text)
                cut.append([])
                continue
            pieces = [p.encode() for p in _WORD_START.split(text.decode())] if _OPEN_BYTES.search(text) else text.split(b" ")
            heads.append(pieces.pop(0))
            cut.append(pieces)
        for head in set(heads).difference(self.head):
            ids = self.trie.encode(head.decode())
            self.head[head] = b"".join([self.decimal[i] for i in ids])
            if self.trie.decode_bytes(ids) != head:
                self.odd.add(b" " + head)  # no piece starts with a space that a word may follow
        if new := set().union(*cut).difference(self.text):
            self._add(new)
        out = []
        for text, head, pieces in zip(texts, heads, cut, strict=True):
            ids = self.head[head] + b"".join(map(self.text.__getitem__, pieces))
            if self.odd and (b" " + head in self.odd or not self.odd.isdisjoint(pieces)):
                text = self._decoded(ids)
            out.append((ids.count(b","), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out

    def _decoded(self, ids: bytes) -> bytes:
        return self.trie.decode([int(i) for i in ids.split(b",")[1:]]).encode()


_BATCH: dict[str, BatchEncoder] = {}


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty ones (no token; digests of the empty string); identifiers pass
    through, null ones and repeated rows too; other columns are not read. A very long text is
    held by one task with its pieces; nothing else grows with it.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _BATCH:
            _BATCH[tokenizer_path] = BatchEncoder(tokenizer_path)
        own = _BATCH[tokenizer_path]
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids, back = zip(*own.digests(part.column("text").cast(pa.binary()).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int) and decoded (string). Nulls as above."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TrieEncoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [own.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
