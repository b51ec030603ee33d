"""64-bit hashes of the words and word shingles of many texts at once.

A word is a longest run of bytes other than space and U+0009 to U+000D.  Its hash is a polynomial of random byte
values modulo 2**64, taken from prefix sums, so that no step loops over words or texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.common import utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUES = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(kind: str, base: int, size: int) -> np.ndarray:
    """base**0 ... base**(size-1) modulo 2**64; kept up to 16 MB."""
    held = _POWERS.get(kind)
    if held is None or len(held) < size:
        held = np.full(max(size, 1 << 16), base, np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if len(held) <= 1 << 21:
            _POWERS[kind] = held
    return held[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """The finisher of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans(held: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all longest runs of bytes that are ``held`` and belong to one text."""
    first = held.copy()
    first[1:] &= ~held[:-1]
    begin = offsets[:-1][offsets[:-1] < len(held)]
    first[begin] = held[begin]
    # A run ends where the next byte is not held or belongs to another text.
    last = held.copy()
    last[:-1] &= ~held[1:]
    last[begin[begin > 0] - 1] = held[begin[begin > 0] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_array(texts: pa.Array, word_bytes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words of many texts, ASCII letters lower-cased: bytes, starts, lowered data, and offsets of the texts into the words.

    ``word_bytes`` tells of every (lowered) byte value whether words hold it.  NULL texts have no words.
    """
    data, offsets = utf8(texts)
    data = _LOWER[data]
    held = word_bytes[data]
    starts, ends = spans(held, offsets) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    buffers = [None, pa.py_buffer(at), pa.py_buffer(data[held])]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    return found, starts, data, np.searchsorted(starts, offsets)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans, none of them empty."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers("up", int(_BASE), len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", _inverse(int(_BASE)), len(data))[starts]
    h += (ends - starts).astype(np.uint64)
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and len+1 offsets of the texts into them.  ASCII letters are lower-cased."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = spans(~_BLANK[data], offsets)
    return hashes_of(_LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` words in a row, sorted within each text, and len+1 offsets of the texts into them.

    A text with fewer words has its whole sequence as one shingle, a text without words none.
    """
    texts = len(bounds) - 1
    lengths = np.diff(bounds)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    firsts = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    owner = np.repeat(np.arange(texts), counts)
    h = np.zeros(len(firsts), np.uint64)
    factor = 1
    for k in range(size):
        at = firsts + k
        inside = at < bounds[owner + 1]
        factor = factor * int(_BASE) % (1 << 64)
        h[inside] += hashes[at[inside]] * np.uint64(factor)
    h = mix(h + lengths[owner].clip(max=size).astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(texts + 1))
