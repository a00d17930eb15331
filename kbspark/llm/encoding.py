"""Token ids of the tokenizers library, with one library call per distinct word.

Texts repeat their words, and the library spends most of its time on alignments that nobody
reads. So a text is cut at places where the tokenizer always starts a new word, and the ids of
each distinct piece are kept in a bounded cache. The cut is exact, not approximate:

* byte-level tokenizers with the usual word pattern start a word at every space that a character
  other than white space follows;
* word tokenizers that drop white space treat the pieces between spaces or line ends alone.

Texts that hold the string of a special token, and tokenizers of any other make, go through the
library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

from tokenizers import Tokenizer

#: Letters for which Python's and the library's classes agree, besides ASCII ones.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf"[\n\x20-\x7e{_LETTERS}]*\Z")
_BYTE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_OPEN_SPACE = re.compile(r" (?:\s|\Z)")
_WORD_START = re.compile(r" (?=\S)")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


#: How a space is written in byte-level vocabularies.
_SPACE = byte_alphabet()[0x20]
_ALPHABET = {b: c for b, c in enumerate(byte_alphabet())}


def as_byte_word(text: str) -> str:
    return text.encode().decode("latin-1").translate(_ALPHABET)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: Entries of an encoder's caches, about 200 bytes each, where nobody asks for another number.
ENTRIES = 600_000


class _Cache(dict):
    """Computes what it lacks; lookups of what it has stay in C."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value


class IdEncoder:
    """Ids of whole texts, exactly as ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    ``max_entries`` bounds the caches together; full ones start anew, which changes speed only.
    """

    def __init__(self, path: str, max_entries: int = ENTRIES):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.max_entries = max_entries
        self.specials = [t["content"] for t in config["added_tokens"]]
        self.model = self.library.model
        self.cut = self._make(config)
        self.words = _Cache(self._model_ids)
        self.heads = _Cache(self._piece_ids)
        self.tails = _Cache(self._tail_ids)

    @staticmethod
    def _make(config: dict) -> str:
        before, normal = config.get("pre_tokenizer") or {}, config.get("normalizer")
        plain = config["model"].get("type") == "BPE" and not config.get("post_processor")
        plain = plain and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in config["added_tokens"])
        if plain and normal is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            return "at spaces before words"
        steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
        parts = before.get("pretokenizers", [])
        if plain and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]:
            pattern = parts[0]["pattern"].get("Regex", "")
            if parts[0]["invert"] and parts[0]["behavior"] == "Removed" and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                return "at white space"
        return "never"

    def _library_ids(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def _model_ids(self, word: str) -> bytes:
        return pack([t.id for t in self.model.tokenize(as_byte_word(word))])

    def _piece_ids(self, piece: str) -> bytes:
        if self.cut == "at white space" and piece.isascii() and piece.isalpha():
            return pack([t.id for t in self.model.tokenize(piece.lower())])
        if not _PLAIN.match(piece) or any(s in piece for s in self.specials):
            return self._library_ids(piece)
        if self.cut == "at white space":
            return b"".join(map(self.words.__getitem__, _LOWER_WORDS.findall(piece.lower())))
        return b"".join(map(self.words.__getitem__, _BYTE_WORDS.findall(piece)))

    def _tail_ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # most pieces: one plain word
            return pack([t.id for t in self.model.tokenize(_SPACE + piece)])
        return self._piece_ids(" " + piece)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.words) + len(self.heads) + len(self.tails) > self.max_entries:
            for cache in (self.words, self.heads, self.tails):
                cache.clear()
        if self.cut == "at white space":
            return b"".join(map(self.heads.__getitem__, text.replace("\n", " ").split(" ")))
        if self.cut == "never" or any(s in text for s in self.specials):
            return self._library_ids(text)
        pieces = _WORD_START.split(text) if _OPEN_SPACE.search(text) else text.split(" ")
        if pieces[0] == "" and len(pieces) > 1:
            return b"".join(map(self.tails.__getitem__, pieces[1:]))
        return self.heads[pieces[0]] + b"".join(map(self.tails.__getitem__, pieces[1:]))


_ENCODERS: dict[tuple[str, int], IdEncoder] = {}


def encoder(path: str, max_entries: int = ENTRIES) -> IdEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    key = path, max_entries
    if key not in _ENCODERS:
        _ENCODERS[key] = IdEncoder(*key)
    return _ENCODERS[key]
