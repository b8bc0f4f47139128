"""Words, k-word shingles and their 64-bit hashes for whole Arrow batches, in NumPy.

All separators are ASCII, so UTF-8 bytes can be classed one by one without decoding.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

from .common import utf8

_U = np.uint64
#: Words of more bytes are hashed one by one, by BLAKE2b.
LONG = 512
_SEEDS = 0x243F6A8885A308D3, 0x13198A2E03707344
_STEP = _U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fold(state: np.ndarray, x: np.ndarray) -> np.ndarray:
    """state with x taken in, in place.  Unlike a polynomial mod 2^64 this has no inputs that always collide."""
    state ^= x
    state *= _STEP
    state ^= state >> _U(32)
    return state


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step; the two seeds give hashes that know nothing of each other."""
    sizes = ends - starts
    raw = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out = mix(raw[starts] & _MASK[np.minimum(sizes, 8)] ^ (sizes.astype(np.uint64) + _U(1)) * _U(_SEEDS[seed] | 1))
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    at = 8
    while len(left):
        part = raw[starts[left] + at] & _MASK[np.minimum(sizes[left] - at, 8)]
        out[left] = mix(fold(out[left], part) + _U(_SEEDS[seed]))
        at += 8
        left = left[sizes[left] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def table(separators: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators if isinstance(separators, bytes) else separators.encode())] = True
    return out


SPACE = table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: All ASCII but 0-9 and a-z, after lower-casing.
NOT_ALNUM = np.array([c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Words:
    """data: the bytes; starts, ends: of each word; off: words off[d] to off[d+1] are of text d; hash, second: by word."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, fold: np.ndarray = SAME):
        self.data, self.text_off = utf8(texts)
        if fold is not SAME:
            self.data = fold[self.data]
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(separators[self.data], out=inside[:n])
        first, last = inside[:n].copy(), inside[:n].copy()
        first[1:] &= ~inside[: n - 1]
        last &= ~inside[1 : n + 1]
        cut = self.text_off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[inside[cut] & inside[cut - 1]]  # a text ends and the next begins inside a run
        first[cut] = True
        last[cut - 1] = True
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.starts, self.text_off)
        self.counts = np.diff(self.off)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hash = word_hashes(self.data, self.starts, self.ends)

    @functools.cached_property
    def second(self) -> np.ndarray:
        """Another hash by word; with the first, 128 bits."""
        return word_hashes(self.data, self.starts, self.ends, 1)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether they are all of one text)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            fold(out, self.hash[j : j + n])
        return mix(out), self.doc[:n] == self.doc[k - 1 :]

    def grams_at(self, starts: np.ndarray, k: int, second: bool = False) -> np.ndarray:
        """grams(k) at these places only; second: by the other hash."""
        hashes, out = self.second if second else self.hash, np.full(len(starts), k, np.uint64)
        for j in range(k):
            fold(out, hashes[starts + j])
        return mix(out)

    def words_of(self, d: int) -> list[bytes]:
        data = self.data.tobytes() if not hasattr(self, "_bytes") else self._bytes
        self._bytes = data
        return [data[a:b] for a, b in zip(self.starts[self.off[d] : self.off[d + 1]].tolist(), self.ends[self.off[d] : self.off[d + 1]].tolist())]


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum, np.maximum) over each `width` neighbours, by doubling."""
    n = len(values) - width + 1
    out, span = values, 1
    while span * 2 <= width:
        out, span = op(out[:-span], out[span:]), span * 2
    return op(out[:n], out[width - span : width - span + n]) if span < width else out[:n]


def minimizers(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are least in some run of `width` grams of one text (ties: all)."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    top = np.iinfo(np.uint64).max
    whole = sliding(np.logical_and, valid, width)
    least = np.where(whole, sliding(np.minimum, np.where(valid, grams, _U(top)), width), _U(0))
    pad = np.zeros(len(grams) + width - 1, np.uint64)
    pad[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero((sliding(np.maximum, pad, width) == grams) & valid & (grams > 0))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in some [start, start + width)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
