"""Word shingle sets and fast similarity sketches, in numpy.

The sketch follows Dahlgaard, Knudsen and Thorup, *Fast Similarity Sketching* (FOCS 2017).
In round ``i`` every element falls into one bin: in the first ``t`` rounds into a hashed
one, in the next ``t`` rounds all into bin ``i - t``.  A bin keeps the least value of the
first round that reached it.  A set stops after the round that fills its last bin, so
sets much larger than ``t`` need one or two rounds and every bin is filled after at most
``2 t``.  Two sets agree in a bin with a probability equal to their Jaccard similarity,
and the number of equal bins is as concentrated as for ``t`` independent hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class _Words(dict):
    """Hash of a word, computed when first met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text.

    Words are runs of bytes other than ASCII white space, ``A-Z`` lower-cased.  A text of
    fewer than ``n`` words has its whole sequence as its only shingle, one without words none.
    """

    def __init__(self, n: int, most_words: int = 120_000):
        self.n, self._most, self._words = n, most_words, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self._words) > self._most:  # forgets words, never texts
            self._words.clear()
        w = np.fromiter(map(self._words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = mix(h + w[i : i + len(h)])
        return np.unique(h)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """``len(sets) x t`` sketch; the row of an empty set holds ``EMPTY`` only."""
    if not 1 <= t <= 128:
        raise ValueError("t must lie between 1 and 128")
    out = np.full((len(sets), t), EMPTY, dtype=np.uint64)
    flat_out = out.reshape(-1)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items ^ mix(np.full(1, i + 1, np.uint64)))
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        if i < t:  # the low 16 bits choose the bin, the other 48 are the value
            cell = ((h & np.uint64(0xFFFF)) * np.uint64(t)) >> np.uint64(16)
            place = row * t + cell.astype(np.int64)
        else:
            place = row * t + (i - t)
        np.minimum.at(flat_out, place, value)
        open_rows = (out == EMPTY).any(axis=1)
        left = open_rows[row]
        if not left.all():
            items, row = items[left], row[left]
    return out


def band_plan(threshold: float, t: int = 128, miss: float = 1e-6) -> tuple[int, int]:
    """``bands, rows``: the longest bands that miss a pair at the threshold with at most ``miss``."""
    for rows in range(t, 0, -1):
        bands = t // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    raise ValueError("no banding of this sketch reaches the bound")


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per set and band; the band's number is part of the key."""
    keys = np.empty((len(sketches), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sketches), b + 1, dtype=np.uint64)
        for r in range(rows):
            h = mix(h + sketches[:, b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
