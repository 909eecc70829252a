"""The perfect binary Golay code [23, 12, 7]: nearest codewords of 23-bit words, vectorised."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each word, read as a polynomial, by the generator."""
    left = words.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return left


def _errors() -> np.ndarray:
    """The error pattern of up to three bits for each of the 2,048 remainders: one each, as the code is perfect."""
    patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)]
    words = np.array(patterns, dtype=np.int64)
    table = np.zeros(1 << CHECKS, dtype=np.int64)
    table[_remainders(words)] = words
    return table


_HIGH = _remainders(np.arange(1 << (LENGTH - CHECKS), dtype=np.int64) << CHECKS)
_ERROR = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest codeword of each 23-bit word."""
    syndrome = _HIGH[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    return (words ^ _ERROR[syndrome]) >> CHECKS


def nearby(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """Indices that a word, or a word one bit away, decodes to: one row of 1 + width columns, with repeats.

    There are one or six different ones. Two words at most one bit apart share what the other decodes to.
    """
    flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    return decode(words[:, None] ^ flips[None, :])
