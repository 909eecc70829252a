"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `size` white-space words, A-Z lower-cased and joined by blanks, repeats included.

    Fewer words make one shingle of them all; none make none.
    """
    words = text.encode().lower().split()  # on bytes, both touch ASCII only
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
