"""A linear-chain conditional random field over words, in NumPy, for batches of chains."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np

HASH_BITS = 16  # features of up to WIDE labels; fewer bits beyond, as a weight is held per feature and label
WIDE = 64


def hashed_features(labels: int) -> int:
    """Number of hashed features: a power of two that keeps features x labels within a fixed size."""
    return 1 << max(10, HASH_BITS - max(0, math.ceil(math.log2(max(labels, 1) / WIDE))))


def features(word: str, lexicons: list[frozenset[str]]) -> list[int]:
    """Hashed affixes and character n-grams of a lower-cased word, and the lexicons that hold it.

    Every letter counts: words are chain positions of a bounded length.
    """
    crc, size = zlib.crc32, hashed_features(len(lexicons))
    mask = size - 1
    data = f"^{word}$".encode()
    out = [crc(data[:n], 1) & mask for n in (2, 3, 4)] + [crc(data[-n:], 2) & mask for n in (2, 3, 4, 5)]
    out += [crc(data[i : i + 3], 3) & mask for i in range(len(data) - 2)]
    out += [crc(data[i : i + 2], 4) & mask for i in range(len(data) - 1)]
    out += [size + k for k, lexicon in enumerate(lexicons) if word in lexicon]
    return out


def word_scores(words: list[str], weights: np.ndarray, lexicons: list[frozenset[str]]) -> np.ndarray:
    """Sum of the feature weights of each word: one row of label scores."""
    lists = [features(word, lexicons) for word in words]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((f for one in lists for f in one), dtype=np.int64, count=int(sizes.sum()))
    return np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Posterior label probabilities of every word, for chains at `starts` in the flat table `emit`.

    `emit` and `moves` hold positive factors. Chains are taken longest first, so that step t works on
    a leading block of them and nothing is padded. With `pairs`, also the expected label changes.
    """
    order = np.argsort(-lengths, kind="stable")
    at, long = starts[order], lengths[order]
    active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    gamma = np.empty_like(emit)
    alphas = []
    alpha = None
    for t, k in enumerate(active):
        step = emit[at[:k] + t]
        alpha = step if alpha is None else (alpha[:k] @ moves) * step
        alpha = alpha / alpha.sum(axis=1, keepdims=True)
        alphas.append(alpha)
    beta = np.ones((0, emit.shape[1]), dtype=emit.dtype)
    expected = np.zeros_like(moves)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        beta = np.concatenate([beta, np.ones((k - len(beta), emit.shape[1]), dtype=emit.dtype)])
        here = alphas[t] * beta
        gamma[at[:k] + t] = here / here.sum(axis=1, keepdims=True)
        if t:
            back = emit[at[:k] + t] * beta
            if pairs:
                before = alphas[t - 1][:k]
                total = ((before @ moves) * back).sum(axis=1, keepdims=True)
                expected += moves * ((before / total).T @ back)
            beta = back @ moves.T
            beta = beta / beta.sum(axis=1, keepdims=True)
    return (gamma, expected) if pairs else gamma


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    moves: np.ndarray  # (labels, labels), log scale
    lexicons: list[frozenset[str]]


def fit(
    chains: list[tuple[list[str], list[int]]], labels: list[str], lexicon_size: int = 1500, rounds: int = 40, decay: float = 2e-6
) -> Model:
    """Maximum likelihood of the word labels of `chains`, by gradient steps scaled per weight."""
    counts = [{} for _ in labels]
    for words, tags in chains:
        for word, tag in zip(words, tags, strict=True):
            counts[tag][word] = counts[tag].get(word, 0) + 1
    lexicons = []
    for own in counts:  # words that are frequent here and rarer in all other labels together
        rest = {w: sum(c.get(w, 0) for c in counts) - n for w, n in own.items()}
        good = sorted((w for w, n in own.items() if n >= 3 and n > rest[w]), key=lambda w: (-own[w], w))
        lexicons.append(frozenset(good[:lexicon_size]))
    vocabulary: dict[str, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary)) for words, _ in chains for w in words], dtype=np.int64)
    gold = np.array([tag for _, tags in chains for tag in tags], dtype=np.int64)
    lengths = np.array([len(words) for words, _ in chains], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    lists = [features(word, lexicons) for word in vocabulary]
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(one) for one in lists])
    feats = np.fromiter((f for one in lists for f in one), dtype=np.int32, count=len(rows))
    heads = np.concatenate([[0], np.cumsum([len(one) for one in lists])[:-1]])
    del lists
    n_labels, n_feats = len(labels), hashed_features(len(labels)) + len(lexicons)
    inside = np.ones(len(flat), dtype=bool)
    inside[starts] = False
    moved = np.zeros((n_labels, n_labels))
    np.add.at(moved, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)

    def by_word(table: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(flat, table[:, k], len(vocabulary)) for k in range(n_labels)], axis=1)

    observed = by_word(np.eye(n_labels)[gold])
    weights, moves = np.zeros((n_feats, n_labels)), np.zeros((n_labels, n_labels))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(rounds):
        scores = np.stack([np.add.reduceat(weights[feats, k], heads) for k in range(n_labels)], axis=1)
        scores -= scores.max(axis=1, keepdims=True)
        gamma, expected = forward_backward(np.exp(scores)[flat] + 1e-30, starts, lengths, np.exp(moves), pairs=True)
        off = observed - by_word(gamma)
        step = np.stack([np.bincount(feats, off[rows, k], n_feats) for k in range(n_labels)], axis=1) / len(flat)
        step -= decay * weights
        seen_w += step * step
        weights += 0.5 * step / np.sqrt(seen_w)
        turn = (moved - expected) / len(flat) - decay * moves
        seen_m += turn * turn
        moves += 0.3 * turn / np.sqrt(seen_m)
    return Model(labels, weights.astype(np.float32), moves.astype(np.float32), lexicons)
