"""Monotone sequences in Elias-Fano form, searched many values at a time.

Each value's low bits are packed one after the other; the high bits are written in unary into a bit
vector: value number i with high part h sets bit h + i. Directories with the zeros before each
64-bit word make the start of a high part, and the value at a place, one lookup away. All parts
are plain arrays, so a file of them can be mapped into memory and read where needed.
"""

from __future__ import annotations

import json
import struct

import numpy as np

_PLACE = np.zeros((256, 8), np.uint8)  # place of the r-th set bit of a byte
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _PLACE[_b, _r] = _p
_PLACE = _PLACE.ravel()
_PAIRS, _FOURS, _EIGHTS = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each 64-bit word, all bytes of a word counted at once."""
    one, two, three, four, seven, eight = (np.uint64(x) for x in (1, 2, 3, 4, 7, 8))
    words, r = np.asarray(words, np.uint64), r.astype(np.uint64)
    upto = words - (words >> one & _PAIRS)
    upto = (upto & _FOURS) + (upto >> two & _FOURS)
    upto = (upto + (upto >> four) & _EIGHTS) * _ONES  # in each byte: the ones up to its end
    full = ((r * _ONES | _TOPS) - upto & _TOPS) >> seven  # 1 in each byte whose ones end at r or before
    at = (full * _ONES >> np.uint64(56)) << three
    before = (upto << eight) >> at & np.uint64(255)
    return (at + _PLACE[((words >> at & np.uint64(255)) << three) + r - before]).astype(np.int64)


class EliasFano:
    """meta: n, low (bits); arrays: high ('<u8'), zeros ('<u8'), lower (bytes, padded by 8)."""

    def __init__(self, n: int, low: int, high: np.ndarray, zeros: np.ndarray, lower: np.ndarray):
        self.n, self.low, self.high, self.zeros, self.lower = n, low, high, zeros, lower
        # A view that starts a 64-bit integer at each byte.
        self.at_byte = np.ndarray((max(0, len(lower) - 7),), "<u8", buffer=lower, strides=(1,))

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """values: ascending unsigned 64-bit integers, repeats allowed."""
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low = min(56, max(0, (most // max(1, n)).bit_length() - 1))
        highs = (values >> np.uint64(low)).astype(np.int64)
        size = -(-(n + (most >> low) + 2) // 64) * 64
        bits = np.zeros(size, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))[:-1]]).astype("<u8")
        parts = []
        for first in range(0, n if low else 0, 1 << 15):  # whole bytes: a multiple of 8 values
            some = values[first : first + (1 << 15), None] >> np.arange(low, dtype=np.uint64)[None, :] & np.uint64(1)
            parts.append(np.packbits(some.astype(np.uint8).ravel(), bitorder="little"))
        return cls(n, low, high, zeros, np.concatenate([*parts, np.zeros(8, np.uint8)]))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        return self.at_byte[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low) - 1)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """Values whose high part is under the given one."""
        k = np.maximum(high - 1, 0)  # the zero that ends the part before
        word = np.searchsorted(self.zeros, k.astype(np.uint64), "right") - 1
        place = 64 * word + _select_in_word(~self.high[word], k - self.zeros[word].astype(np.int64))
        return np.where(high > 0, place - k, 0)

    def search(self, values: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1; optionally only among places from first up to stop."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> np.uint64(self.low)).astype(np.int64)
        most = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))  # zeros altogether
        inside = np.flatnonzero((high >= 0) & (high + 1 < most))
        high = high[inside]
        at, end = self._before(high), self._before(high + 1)
        if first is not None:
            at, end = np.maximum(at, first[inside]), np.minimum(end, stop[inside])
        low = values[inside] & np.uint64((1 << self.low) - 1)
        # The low bits ascend within a high part, which a dense context may fill with thousands of values.
        stop_, alive = end.copy(), np.flatnonzero(at < end)
        while len(alive):
            middle = (at[alive] + stop_[alive]) >> 1
            under = self._lows(middle) < low[alive]
            at[alive[under]] = middle[under] + 1
            stop_[alive[~under]] = middle[~under]
            alive = alive[at[alive] < stop_[alive]]
        there = np.flatnonzero(at < end)
        hit = there[self._lows(at[there]) == low[there]]
        out[inside[hit]] = at[hit]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        # Ones before a word: all its bits before, less the zeros.
        ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros.astype(np.int64) if len(self.zeros) <= 1 << 16 else None
        if ones is None:
            low, high = np.zeros(len(i), np.int64), np.full(len(i), len(self.zeros) - 1, np.int64)
            while (low < high).any():
                middle = (low + high + 1) >> 1
                under = 64 * middle - self.zeros[middle].astype(np.int64) <= i
                low, high = np.where(under, middle, low), np.where(under, high, middle - 1)
            word = low
        else:
            word = np.searchsorted(ones, i, "right") - 1
        before = 64 * word - self.zeros[word].astype(np.int64)
        place = 64 * word + _select_in_word(self.high[word], i - before)
        return (place - i).astype(np.uint64) << np.uint64(self.low) | (self._lows(i) if self.low else np.uint64(0))

    def parts(self) -> tuple[dict, list[np.ndarray]]:
        return {"n": self.n, "low": self.low}, [self.high, self.zeros, self.lower]


def dump(sequences: dict[str, EliasFano], arrays: dict[str, np.ndarray], meta: dict) -> bytes:
    """One file: length of a JSON head, the head, then arrays that start at multiples of 8."""
    head: dict = {"meta": meta, "sequences": {}, "arrays": {}}
    body, at = [], 0

    def put(a: np.ndarray) -> list:
        nonlocal at
        data = a.tobytes()
        place = [at, len(a), a.dtype.str]
        body.append(data + b"\0" * (-len(data) % 8))
        at += len(body[-1])
        return place

    for name, s in sequences.items():
        own, parts = s.parts()
        head["sequences"][name] = own | {"parts": [put(p) for p in parts]}
    for name, a in arrays.items():
        head["arrays"][name] = put(a)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(body)


def load(data: np.ndarray) -> tuple[dict[str, EliasFano], dict[str, np.ndarray], dict]:
    """From the bytes of such a file, mapped or read; nothing is copied."""
    size = struct.unpack("<Q", data[:8].tobytes())[0]
    head, body = json.loads(data[8 : 8 + size].tobytes()), data[8 + size :]

    def take(place: list) -> np.ndarray:
        at, n, kind = place
        return body[at : at + n * np.dtype(kind).itemsize].view(kind)

    sequences = {name: EliasFano(s["n"], s["low"], *map(take, s["parts"])) for name, s in head["sequences"].items()}
    return sequences, {name: take(p) for name, p in head["arrays"].items()}, head["meta"]
