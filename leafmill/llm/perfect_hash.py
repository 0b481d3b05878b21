"""Minimal perfect hash of a bounded set of 64-bit keys, with the keys kept for verification."""

from __future__ import annotations

import numpy as np

from leafmill.llm.shingles import mix

#: Bits of a level per key that is left.
SPACE = 2
MOST_LEVELS = 64


class PerfectHash:
    """Slots 0 .. n-1 for n distinct keys.  Each level hashes the keys that are left into twice as many bits; a key
    alone in its bit is placed there, the others go to the next level.  A key's slot is the number of set bits before
    its own, over all levels."""

    def __init__(self, keys: np.ndarray):
        left = np.unique(keys.astype(np.uint64))
        self.sizes, levels = [], []
        while len(left):
            if len(self.sizes) == MOST_LEVELS:
                raise ValueError("keys can't be told apart")
            words = -(-SPACE * len(left) // 64)
            self.sizes.append(64 * words)
            bit = self._bit(left, len(self.sizes) - 1)
            alone = np.bincount(bit, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[bit]]
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bits = np.concatenate(levels or [np.zeros(0, "<u8")])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        self.keys = np.zeros(self.ranks[-1], np.uint64)
        slots = self._slots(keys.astype(np.uint64))
        self.keys[slots] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _bit(self, keys: np.ndarray, level: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64))
        return (mix(keys + seed) % np.uint64(self.sizes[level])).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys that no level places."""
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.sizes)):
            bit = self._bit(keys[left], level) + self.begins[level]
            word, shift = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            here = (word >> shift & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            slots[left[here]] = (self.ranks[bit >> 6] + below)[here]
            left = left[~here]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for a key that is not in the set."""
        keys = keys.astype(np.uint64)
        slots = self._slots(keys)
        if len(self.keys):
            slots[self.keys[slots] != keys] = -1
        return slots
