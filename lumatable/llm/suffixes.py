"""Suffix arrays by the difference-cover algorithm, and windows anchored by content; NumPy on bounded texts."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of `text` (positive integers) in order.

    Suffixes at positions 1 and 2 modulo 3 (a difference cover) are sorted by their first three letters and
    named; if names repeat, the string of names is sorted by the same method. The remaining suffixes
    follow from one letter and the next name, and both lists are merged.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    letters = np.concatenate([text.astype(np.int64), np.zeros(3, dtype=np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    base = int(letters.max()) + 1
    if base < 1 << 21:  # three letters fit one integer
        key = (letters[sample] * base + letters[sample + 1]) * base + letters[sample + 2]
    else:
        pair = letters[sample + 1] * base + letters[sample + 2]
        key = letters[sample] * (len(sample) + 1) + np.unique(pair, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.concatenate([[1], ranked[1:] != ranked[:-1]]).cumsum()
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = fresh
    if fresh[-1] < len(sample):
        deeper = suffix_array(names)
        names[deeper] = np.arange(1, len(sample) + 1)
        order = deeper
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    width = len(sample) + 2
    zero = np.arange(0, n, 3)
    zero_key = letters[zero] * width + rank[zero + 1]
    by_key = np.argsort(zero_key, kind="stable")
    zero, zero_key = zero[by_key], zero_key[by_key]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    below = np.searchsorted(letters[first] * width + rank[first + 1], zero_key)

    def pairs(at: np.ndarray) -> np.ndarray:
        return (letters[at] * base + letters[at + 1]) * width + rank[at + 2]

    if base * base * width < 1 << 62:
        below += np.searchsorted(pairs(second), pairs(zero))
    else:
        both = np.concatenate([second, zero])
        inner = np.unique(letters[both + 1] * width + rank[both + 2], return_inverse=True)[1]
        key = letters[both] * (len(both) + 1) + inner
        below += np.searchsorted(key[: len(second)], key[len(second) :])
    out = np.empty(n, dtype=np.int64)
    slots = np.arange(len(zero)) + below
    rest = np.ones(n, dtype=bool)
    rest[slots] = False
    out[slots], out[rest] = zero, sorted_sample
    return out


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in `order` starts with the same `length` letters (bytes) as the one before it."""
    data = np.concatenate([text.astype(np.uint8), np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view("<u8").reshape(-1)
    same = np.concatenate([[False], np.ones(len(order) - 1, dtype=bool)]) if len(order) else np.zeros(0, dtype=bool)
    same[1:] &= (order[1:] + length <= len(text)) & (order[:-1] + length <= len(text))
    for step in [*range(0, length - 8, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = words[order[at] + step] == words[order[at - 1] + step]
    return same


class Anchors:
    """Cuts texts into runs of windows that share an anchor.

    The anchor of a window is the place in it where a hash of `gram` bytes is least, the first such.
    It depends on the window's bytes only, so equal windows anywhere have equal anchors.
    """

    MULTIPLIER = 0x9E3779B97F4A7C15 | 1
    PLACE_BITS = 24

    def __init__(self, length: int = 100, gram: int = 48, chunk: int = 1 << 17):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        self.limit = (1 << self.PLACE_BITS) - 1
        self.chunk = chunk
        self.powers = self.inverses = np.empty(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            step = np.full(n, self.MULTIPLIER, dtype=np.uint64)
            step[0] = 1
            self.powers = np.multiply.accumulate(step)
            step[1:] = pow(self.MULTIPLIER, -1, 1 << 64)
            self.inverses = np.multiply.accumulate(step)

    def segments(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, first window, last window) of the runs in `data`; windows may cross texts in it."""
        n = len(data)
        if n < self.length:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, empty
        self._grow(n)
        rolled = np.empty(n + 1, dtype=np.uint64)
        rolled[0] = 0
        np.cumsum(np.frombuffer(data, dtype=np.uint8) * self.powers[:n], out=rolled[1:])
        grams = (rolled[self.gram :] - rolled[: n + 1 - self.gram]) * self.inverses[: n + 1 - self.gram]
        mixed = grams ^ (grams >> np.uint64(29))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64(self.limit)
        least = (mixed & ~low) | np.arange(len(mixed), dtype=np.uint64)
        size = 1
        while size * 2 <= self.span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < self.span:
            over = self.span - size
            least = np.minimum(least[:-over], least[over:])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        return mixed[place[first]].view(np.int64), first, last

    def batches(self, texts: list[bytes]):
        """Joins texts up to about `chunk` bytes: (gram hash, text number, first window, last window, joined text, its start).

        No joined text is longer than the place bits allow. Windows that cross texts are cut off; longer texts than the place bits allow are taken in
        overlapping parts, which changes where runs end but not which windows there are.
        """
        group: list[tuple[int, int, bytes]] = []
        size = 0
        step = self.limit - self.length
        for number, text in enumerate(texts):
            if len(text) < self.length:
                continue
            for at in range(0, len(text) - self.length + 1, step):
                part = text[at : at + step + self.length - 1] if len(text) > step else text
                if group and size + len(part) > self.limit:
                    yield self._cut(group)
                    group, size = [], 0
                group.append((number, at, part))
                size += len(part)
                if size >= self.chunk:
                    yield self._cut(group)
                    group, size = [], 0
        if group:
            yield self._cut(group)

    def _cut(self, group: list[tuple[int, int, bytes]]):
        data = b"".join(part for _, _, part in group)
        hashes, first, last = self.segments(data)
        ends = np.cumsum([len(part) for _, _, part in group])
        starts = ends - np.array([len(part) for _, _, part in group])
        # A run may reach over several texts: it is split at their starts.
        cuts = starts[1:]
        owner = np.searchsorted(ends, first, side="right")
        if len(cuts):
            inner = cuts[(np.searchsorted(first, cuts, side="right") > 0)]
            run = np.searchsorted(first, inner, side="right") - 1
            split = (inner > first[run]) & (inner <= last[run])
            hashes = np.concatenate([hashes, hashes[run[split]]])
            tails = last[run[split]]
            first2 = np.concatenate([first, inner[split]])
            last2 = np.concatenate([last, tails])
            owner = np.searchsorted(ends, first2, side="right")
            first, last = first2, last2
        last = np.minimum(last, ends[owner] - self.length)
        ok = last >= first
        hashes, first, last, owner = hashes[ok], first[ok], last[ok], owner[ok]
        numbers = np.array([number for number, _, _ in group])
        shift = np.array([at for _, at, _ in group]) - starts
        return hashes, numbers[owner], first + shift[owner], last + shift[owner], data, first
