"""The binary Golay code of length 23 as a table: the nearest codeword of every 23-bit word."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from wortlaut.llm.shared import per_worker

#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the cyclic (23, 12) code (a fixed value).
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11


def _remainders() -> np.ndarray:
    """x^i modulo the generator, for every place i of a word."""
    out, x = [], 1
    for _ in range(LENGTH):
        out.append(x)
        x <<= 1
        if x >> CHECKS:
            x ^= GENERATOR
    return np.array(out, np.uint32)


def nearest() -> np.ndarray:
    return per_worker("golay", _nearest)


def _nearest() -> np.ndarray:
    """The index (12 bits) of the only codeword within three bits of each word.

    The code is perfect: each of the 2^11 remainders belongs to exactly one error of at most three bits, so clearing
    that error leaves a codeword, whose upper 12 bits number it.
    """
    places = _remainders()
    error = np.zeros(1 << CHECKS, np.uint32)
    for size in (1, 2, 3):
        for bits in combinations(range(LENGTH), size):
            error[np.bitwise_xor.reduce(places[list(bits)])] = sum(1 << b for b in bits)
    remainder = np.zeros(1, np.uint32)
    for place in places:
        remainder = np.concatenate([remainder, remainder ^ place])
    return ((np.arange(1 << LENGTH, dtype=np.uint32) ^ error[remainder]) >> CHECKS).astype(np.uint16)


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """Row by row, the codeword indices of a word and of all words one bit away within its lower ``width`` bits; a
    repeated index is -1.  Two words that differ in at most one bit: the index of either is among those of the other.
    """
    table = nearest()
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    found = np.sort(table[words[:, None] ^ flips].astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
