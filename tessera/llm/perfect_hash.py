"""Minimal perfect hashing of 64-bit keys in numpy, with stored keys.

Keys go to a bit array of GAMMA bits each; those that meet no other key there are placed, the
others go to the next, smaller array. A key's slot is the number of set bits before its own, so n
keys have the slots 0 to n - 1. As the keys are stored by slot, a lookup of any other key is
answered with -1, never with another key's slot.
"""

from __future__ import annotations

import numpy as np

from .common import mix

GAMMA, ROUNDS = 2.0, 40


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """keys: different numbers of 64 bits. sizes and bits describe the arrays; what ROUNDS arrays did not place is kept sorted."""

    def __init__(self, keys: np.ndarray):
        left = np.asarray(keys, np.uint64)
        self.sizes, parts = [], []
        while len(left) and len(self.sizes) < ROUNDS:
            size = -(-int(GAMMA * len(left)) // 64) * 64 or 64
            at = place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.rest = np.sort(left)
        if len(self.rest) > 1 and (self.rest[1:] == self.rest[:-1]).any():
            raise ValueError("a key occurs twice")
        self._rank()
        slots = self._slots(np.asarray(keys, np.uint64))
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[slots] = keys

    def _rank(self) -> None:
        words = self.bits.view(np.uint64) if len(self.bits) else np.zeros(0, np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that are not there some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_, at = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = at + place(keys[open_], level, size)
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> low) & np.uint64(1) == 1
            w, below = word[hit], value[hit] & ((np.uint64(1) << low[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[w] + np.bitwise_count(below)
            open_ = open_[~hit]
            at += size
        if len(self.rest) and len(open_):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[k] == keys[open_]
            out[open_[found]] = self.before[-1] + k[found]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not there."""
        keys = np.asarray(keys, np.uint64)
        out = self._slots(keys)
        if len(self.keys):
            out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def __getstate__(self):
        return self.sizes, self.bits, self.rest, self.keys

    def __setstate__(self, state):
        self.sizes, self.bits, self.rest, self.keys = state
        self._rank()
