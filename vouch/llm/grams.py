"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class GramHasher:
    """Slots in ``[0, 2**bits)`` of the distinct n-grams of a text.

    N-grams are runs of UTF-8 bytes of the lower-cased text, with a space before its first
    and after its last character, so that word starts and ends are told apart.
    """

    def __init__(self, orders: tuple[int, ...] = (3, 5), bits: int = 17):
        if not orders or min(orders) < 1 or max(orders) > 7:
            raise ValueError("orders must lie between 1 and 7")
        self.orders, self.bits = tuple(orders), bits
        self._stamp = np.zeros(1 << bits, dtype=np.int64)

    def slots(self, text: str | None) -> np.ndarray:
        """Each slot once; none for null and empty texts."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        raw = b" " + text.lower().encode("utf-8", "replace").translate(_SPACES) + b" "
        data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
        parts = []
        for n in self.orders:
            if len(data) < n:
                continue
            key = np.full(len(data) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                key = (key << np.uint64(8)) | data[i : i + len(key)]
            parts.append((key * _MIX) >> np.uint64(64 - self.bits))
        if not parts:
            return np.zeros(0, dtype=np.int64)
        all_slots = np.concatenate(parts).astype(np.int64)
        order = np.arange(len(all_slots))
        self._stamp[all_slots] = order  # the last position at which each slot occurs
        return all_slots[self._stamp[all_slots] == order]
