"""Token counts, packing and sharding against the libraries and brute force."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import awkward, documents, empty
from tokenizers import Tokenizer

from lumatable.llm import packing, sharding, token_counts

LETTERS = list("ab eéÉİΣ \n\t▁.,0<>s/'ßñ́\x00\r\x1c\x85 ") + [
    "  ", "\n\n", "</s>", " the", "ing ", "<|endoftext|>", "'ll", "word,", "\U0001f600"
]


def texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_counts_are_the_librarys(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rows = awkward() + list(enumerate(texts(400), start=100))
    got = token_counts.count_tokens(documents(spark, rows), memo=50, entries=30).collect()
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(empty(spark)).collect() == []


def test_ids_are_the_librarys():
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer, ids = Tokenizer.from_file(path), packing.Ids(path, 100)
    for text in texts(5000):
        assert np.frombuffer(ids.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, pieces, capacity, tokenizer):
    want = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(p)[:5] for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = awkward() + [(100 + k, "the " * (k % 60)) for k in range(300)]
    for capacity in (64, 4096):
        pieces = packing.pack(documents(spark, rows), capacity=capacity).collect()
        used = check_packing(rows, pieces, capacity, tokenizer)
        assert used == packing.bound(Counter(p["length"] for p in pieces), capacity)
    assert packing.pack(empty(spark)).collect() == []


def fewest(lengths, capacity):
    """Exhaustive optimum for a few pieces."""
    for bins in range(len(lengths) + 1):
        for choice in product(range(bins), repeat=len(lengths)):
            loads = [0] * bins
            for length, b in zip(lengths, choice, strict=True):
                loads[b] += length
            if all(load <= capacity for load in loads):
                return bins
    return 0


def test_plans_are_optimal_on_small_tables():
    rng = random.Random(4)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 6))]
        plan = packing.complete(Counter(lengths), 20)
        placed = Counter()
        for pattern, times in plan:
            assert sum(length * n for length, n in pattern) <= 20
            for length, n in pattern:
                placed[length] += n * times
        assert placed == Counter(lengths)
        assert sum(times for _, times in plan) == fewest(lengths, 20)
    # Best fit alone may miss the bound here.
    hard = Counter([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    assert sum(n for _, n in packing.complete(hard, 61)) == packing.bound(hard, 61) == 3


def test_ranks_find_their_places():
    plan = [(((5, 2), (3, 1)), 4), (((3, 3),), 2), (((5, 1),), 1)]
    arrays = packing.place_arrays(plan)
    seen = Counter()
    for length, n in ((5, 9), (3, 10)):
        sequence, offset = packing.locate(arrays, np.full(n, length), np.arange(n))
        seen.update(zip(sequence.tolist(), offset.tolist(), strict=True))
    want = Counter({(s, o): 1 for s in range(4) for o in (0, 5, 10)} | {(s, o): 1 for s in (4, 5) for o in (0, 3, 6)} | {(6, 0): 1})
    assert seen == want


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, t, "en", "a") for i, t in awkward()]
    rows += [(100 + k, f"t{rng.randrange(50)}", "en", rng.choice(["hot"] * 6 + ["b", "c", None])) for k in range(2000)]
    got = sharding.interleave(documents(spark, rows)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    assert sorted(by_shard) == list(range(16))
    counts = [len(v) for v in by_shard.values()]
    assert max(counts) - min(counts) <= 1
    for shard in by_shard.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    source = {r[0]: r[3] for r in rows if r[0] is not None and r[0] >= 100}
    for name in ("hot", "b", "c", None):
        share = [sum(source.get(r["doc_id"], "-") == name for r in shard) for shard in by_shard.values()]
        assert max(share) - min(share) <= 3
    assert sharding.interleave(empty(spark)).collect() == []
    few = sharding.interleave(documents(spark, [(1, "a"), (2, "b")])).collect()
    assert sorted((r["slot"]) for r in few) == [0, 0]
