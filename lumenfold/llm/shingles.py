"""Words and runs of words as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> its 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_known = WordHashes()


def forget() -> None:
    """At a task's end: a worker that waits for other work keeps no words."""
    _known.clear()
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.encode().split() if text else []


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbours, in order."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for k in range(1, size):
        acc *= _ODD
        acc += h[k : n + k]
    return mixed(acc)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` lower-cased words; of a shorter text its whole sequence."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = hashes(found)
    if len(found) < size:
        return runs(h, len(found)) ^ mixed(np.array([len(found)], np.uint64))
    return np.unique(runs(h, size))
