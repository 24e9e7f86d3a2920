"""Word and window codes, computed a document at a time inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

VOCABULARY_ENTRIES = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


class WordCodes(dict):
    """64-bit code of a word, remembered; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY_ENTRIES:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Code of every run of ``size`` words; empty if there are fewer words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codes[:n].copy()
    for j in range(1, size):
        out *= _STEP
        out += codes[j : j + n]
    return mix(out)


def covered_by_repeats(codes: np.ndarray, size: int) -> int:
    """Words that lie in a window which occurs at least twice, first occurrences included."""
    w = windows(codes, size)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(w, again))
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))
