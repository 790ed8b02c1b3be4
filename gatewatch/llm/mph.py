"""Minimal perfect hashing: levels of bit arrays in which keys that are alone at their place rest, the others going on to the next
level. A key's slot is the number of bits set before its own, so n keys have the slots 0 to n - 1."""

from __future__ import annotations

import numpy as np

from .tokens import GOLDEN, mix

#: Bits a key on each level, and levels at most; keys left then (equal hashes) are known to `left`.
GAMMA, LEVELS = 2, 48


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        """sizes: of the levels in words of 64 bits; words: their bits."""
        self.sizes, self.words = sizes, words
        self.starts = np.cumsum(sizes) - sizes
        self.before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    @property
    def placed(self) -> int:
        return int(np.bitwise_count(self.words).sum())

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """Of 64-bit hashes; those that occur twice find no place."""
        sizes, words, rest = [], [np.zeros(0, np.uint64)], hashes
        while len(rest) and len(sizes) < LEVELS:
            size = len(rest) * GAMMA // 64 + 1
            at = cls.place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size * 64) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level) * GOLDEN) % np.uint64(size * 64)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no level has its bit; a key that was not built in may get any slot."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            if not len(open_):
                break
            at = self.place(hashes[open_], level, size)
            word, bit = start + (at >> 6), (at & 63).astype(np.uint64)
            bits = self.words[word]
            hit = (bits >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below[hit]
            open_ = open_[~hit]
        return out
