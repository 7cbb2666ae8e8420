"""Word shingles as 64-bit hashes, a batch at a time in numpy; fixed-size Bloom filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes hashed in one step.
STEP = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _series(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_ODD))


_BYTE = _series(256, 11)
_PLACE = _series(WIDTH, 12) | np.uint64(1)
_FEW = _series(WIDTH, 13)
_BASE = int(_series(1, 14)[0]) | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of non-space bytes."""
    blank = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words cut at ASCII white space.

    A text of fewer words than width is one shingle, one without words none.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    at = 0
    while at < len(raw):
        size, end = len(raw[at]), at + 1
        while end < len(raw) and size + len(raw[end]) < STEP:
            size += len(raw[end]) + 1
            end += 1
        joined = b" ".join(raw[at:end])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cut = 0
        while cut < len(joined):
            stop = min(len(joined), cut + STEP)
            while stop < len(joined) and not _SPACE[joined[stop]]:
                stop += 1
            starts, hashes = _word_hashes(np.frombuffer(joined, np.uint8, stop - cut, cut))
            found.append((starts + cut, hashes))
            cut = stop
        starts = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        words = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw[at:end]]))
        n = len(words) - width + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(width):
            if n > 0:
                grams += words[k : k + n] * _PLACE[k]
        grams = mixed(grams)
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield mixed((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _FEW[b - a : b - a + 1])
            else:
                yield np.zeros(0, np.uint64)
        at = end


def set_id(grams: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bloom:
    """A Bloom filter of fixed size over 64-bit hashes. Filling it up only makes it say yes more often."""

    PROBES = 4

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @classmethod
    def places(cls, hashes: np.ndarray, bits: int) -> np.ndarray:
        mask = np.uint64(bits - 1)
        a, b = mixed(hashes ^ np.uint64(_ODD)), mixed(hashes + np.uint64(_ODD)) | np.uint64(1)
        return np.concatenate([(a + np.uint64(k) * b) & mask for k in range(cls.PROBES)]) if len(hashes) else np.zeros(0, np.uint64)

    @classmethod
    def masks(cls, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, mask) of the filter that holds hashes, words that have none left out."""
        at = cls.places(hashes, bits)
        word, place = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
        return word[first], (np.bitwise_or.reduceat(place, first) if len(first) else place).view(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        at = self.places(hashes, len(self.words) * 64)
        hit = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return hit.reshape(self.PROBES, n).all(axis=0) if n else np.zeros(0, bool)
