"""A minimal perfect hash over 64-bit keys in levels of bits, built and asked with whole arrays."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

_WORD = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 64-bit numbers (the finalizer of SplitMix64; its two factors are fixed values)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits that tell a foreign key apart."""
    return (mixed(keys, 0) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Level by level, a key that falls on a place of its own sets its bit; the others go on to the next level.  The
    number of a key is the number of bits before its own.  About four bits a key, and two probes on average."""

    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        """``keys`` are distinct; ``room`` is the number of places per key of a level."""
        sizes, words, left = [], [], keys.astype(np.uint64)
        while len(left):
            size = -(-int(room * len(left)) // _WORD) * _WORD + _WORD
            at = (mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.empty(0, "<u8")
        return cls(sizes, bits, cls._ranks(bits))

    @classmethod
    def of(cls, sizes: Iterable[int], bits: np.ndarray) -> PerfectHash:
        return cls(list(sizes), bits, cls._ranks(bits))

    @staticmethod
    def _ranks(bits: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(bits).astype(np.int64)
        return np.cumsum(counts) - counts

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, from 0; -1, or some other key's place, for a foreign key."""
        keys = keys.astype(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[open_], level + 1) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
            if not len(open_):
                break
        return out
