"""Words of many texts at once, found on bytes: for classes of characters in which all of
non-ASCII stands together, so that a byte says whether it belongs to a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .ngram_lm import byte_list

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def letters(digits: bool) -> np.ndarray:
    """Which bytes, A-Z lower-cased, belong to words: letters of ASCII, all of non-ASCII, and digits if asked for."""
    out = np.zeros(256, bool)
    out[0x61:0x7B], out[0x80:] = True, True
    out[0x30:0x3A] = digits
    return out


def found(texts: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of binary texts without nulls, A-Z lower-cased: their bytes and the first byte of each text (a zero
    stands between texts), then where words start and stop in them."""
    sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts)) if isinstance(texts, list) else np.diff(_offsets(texts))
    data = LOWER[np.frombuffer(b"\0".join(texts if isinstance(texts, list) else texts.to_pylist()), np.uint8)]
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(sizes)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = of[data]
    turns = np.diff(inside)
    return data, first, np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = texts.cast(pa.large_binary())
    return np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, 8 * wide.offset)


def encoded(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The words as places in a list, and that list of distinct words."""
    sizes = stop - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[stop] -= 1
    letters_ = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(letters_.tobytes())]).dictionary_encode()
    return flat.indices.to_numpy(), byte_list(flat.dictionary)
