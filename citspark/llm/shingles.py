"""Word shingle sets and SuperMinHash signatures, in NumPy over many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import fold

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _step(k: int) -> np.uint64:
    return _U(int(_GOLD) * k & (1 << 64) - 1)


class WordHashes(dict):
    """64-bit hashes of words; keeps the first ``limit`` words it meets."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_HASHES = WordHashes()


def text_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    return fold(text).split()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; all words as one if fewer."""
    words = text_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _HASHES.of(words)
    n = min(k, len(h))
    rows = len(h) - n + 1
    out = np.full(rows, _U(n), dtype=np.uint64)
    for d in range(n):
        out = mix(out * _GOLD + h[d : d + rows]) if d + 1 == n else out * _GOLD + h[d : d + rows]
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values a set (empty sets: zeros).

    An element's ranks over the m components are a random permutation, drawn by
    Fisher-Yates steps; its value in component j is rank + uniform.  A component
    keeps the least value of all elements.  Here all elements take their step k
    together: step k only fills components that no step before has filled, and a
    set stops as soon as all its components are filled, because later steps
    cannot lower them.  A swap list is traced back instead of storing m places
    for each element.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sig = np.zeros((n, m), dtype=np.uint64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return sig
    elem = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, sizes[live])
    filled = np.zeros(n * m, dtype=bool)
    flat = sig.reshape(-1)
    swaps: list[np.ndarray] = []
    for k in range(m):
        draw = mix(elem + _step(2 * k + 1))
        j = (k + (((draw >> _U(32)) * _U(m - k)) >> _U(32)).astype(np.int64)).astype(np.int32)
        place = j
        for i in range(k - 1, -1, -1):
            place = np.where(place == swaps[i], np.int32(i), place)
        swaps.append(j)
        slot = owner * m + place
        open_ = ~filled[slot]
        slot, value = slot[open_], mix(elem[open_] ^ _step(2 * k + 2))
        best = np.full(n * m, np.iinfo(np.uint64).max, dtype=np.uint64) if k == 0 else None
        if best is not None:
            np.minimum.at(best, slot, value)
            hit = np.flatnonzero(best != np.iinfo(np.uint64).max)
            flat[hit] = best[hit]
        else:
            order = np.lexsort((value, slot))
            slot, value = slot[order], value[order]
            first = np.ones(len(slot), dtype=bool)
            first[1:] = slot[1:] != slot[:-1]
            hit = slot[first]
            flat[hit] = value[first]
        filled[hit] = True
        done = filled.reshape(n, m).all(axis=1)
        keep = ~done[owner]
        if not keep.any():
            break
        if not keep.all():
            elem, owner, swaps = elem[keep], owner[keep], [s[keep] for s in swaps]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` components."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows)).copy()
    for d in range(rows):
        key = key * _GOLD + parts[:, :, d]
        key = key ^ (key >> _U(29))
    return mix(key).view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
