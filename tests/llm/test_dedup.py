"""Suffix-array dedup, SimHash groups and sketches against brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, empty, words

from lumatable.llm import golay, simhash, sketches, suffix_dedup
from lumatable.llm.components import components
from lumatable.llm.suffixes import Anchors, equal_prefixes, suffix_array


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        text = rng.integers(1, rng.integers(2, 6), int(rng.integers(0, 70)))
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i, t=text: t[i:].tolist())
        same = equal_prefixes(text, order, 8)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :][:8].tolist(), text[order[k] :][:8].tolist()
            assert same[k] == (len(a) == len(b) == 8 and a == b)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    texts = [words(rng, n, 12).encode() for n in (0, 5, 30, 300, 40, 900)]
    seen = {}
    covered = [0] * len(texts)
    for hashes, number, lo, hi, data, at in Anchors(100, chunk=3000).batches(texts):
        for h, k, a, z, place in zip(hashes.tolist(), number.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
            assert data[place : place + z - a + 100] == texts[k][a : z + 100]
            covered[k] += z - a + 1
            for p in range(a, z + 1):
                assert seen.setdefault(texts[k][p : p + 100], h) == h
    assert covered == [max(0, len(t) - 99) for t in texts]


def test_joined_texts_fit_the_place_bits():
    class Narrow(Anchors):
        PLACE_BITS = 11

    rng = random.Random(6)
    texts = [words(rng, n, 3_000).encode() for n in (100, 280, 350, 30, 2_000, 90, 300)]
    texts.append(texts[1])
    seen = {}
    for hashes, number, lo, hi, data, _ in Narrow(100, chunk=1_500).batches(texts):
        assert len(data) <= 2_047
        for h, k, a, z in zip(hashes.tolist(), number.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for p in range(a, z + 1):
                assert seen.setdefault(texts[k][p : p + 100], h) == h
    assert seen.keys() == {t[p : p + 100] for t in texts for p in range(len(t) - 99)}


def brute_removal(rows, length):
    """Rows in order of id; equal rows are one document."""
    docs = list(dict.fromkeys(rows))
    seen, out = set(), {}
    for row in docs:
        data = (row[1] or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(data[p : p + length])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[row] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("max_classes", [1024, 3])
def test_suffix_dedup(spark, max_classes):
    rng = random.Random(7)
    passages = [words(rng, 40, 300) for _ in range(4)]
    rows = [(i, t) for i, t in awkward() if i not in (None, 9)]
    rows += [(9, "one")]
    for k in range(60):
        parts = [words(rng, rng.randrange(12), 30), rng.choice(passages), "ab" * rng.randrange(120), words(rng, 5, 20), rng.choice(passages)[: rng.randrange(250)]]
        rows.append((100 + k, " ".join(parts)))
    rows.append((500, rows[-1][1]))
    got = suffix_dedup.remove_repeats(documents(spark, rows), max_classes=max_classes).collect()
    want = brute_removal(sorted(rows, key=lambda r: r[0]), 100)
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *want[r]) for r in rows), key=str)
    assert sum(r["n_removed"] for r in got) > 0


def test_suffix_dedup_of_awkward_tables(spark):
    text = "x" * 250
    got = suffix_dedup.remove_repeats(documents(spark, [(None, text), (None, None), (5, text), (5, text)])).collect()
    kept = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got)
    # In the first document all windows but the first repeat; a row without id comes last and goes whole.
    assert kept == [("5", 250, 249), ("5", 250, 249), ("None", 0, 0), ("None", 250, 250)]
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == []


def slow_print(text):
    data = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not data:
        return 0
    shingles = [" ".join(data[i : i + 3]) for i in range(len(data) - 2)] or [" ".join(data)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_golay():
    rng = np.random.default_rng(1)
    words_ = rng.integers(0, 1 << 23, 3000)
    codewords = golay.decode(words_)
    for bits in (1, 2, 3):  # the code is perfect: a codeword with up to three errors decodes to itself
        code = words_ ^ golay._ERROR[golay._remainders(words_)]
        wrong = code.copy()
        for k in range(len(wrong)):
            for b in rng.choice(23, bits, replace=False):
                wrong[k] ^= 1 << int(b)
        assert (golay.decode(wrong) == codewords).all()
    sizes = {len(set(row)) for row in golay.nearby(words_).tolist()}
    assert sizes == {1, 6}


def test_keys_find_all_close_fingerprints():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    other = prints.copy()
    for k in range(len(other)):
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    stored, probes = ({}, {})
    for held, (row, key) in ((stored, simhash.stored_keys(prints)), (probes, simhash.probe_keys(other))):
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            held.setdefault(r, set()).add(k)
    assert all(stored[k] & probes[k] for k in range(len(prints)))
    # Keys of the seven kinds never meet, and all are long.
    assert {k >> 36 for held in stored.values() for k in held} == set(range(7))
    assert sum(map(len, stored.values())) < 65 * len(prints) and sum(map(len, probes.values())) < 13 * len(prints)


def groups(prints):
    """Smallest id reachable over links of three or fewer bits."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def near_rows():
    rng = random.Random(9)
    rows = list(awkward())
    for k in range(25):
        base = words(rng, rng.randrange(20, 400)).split()
        for c in range(rng.randrange(1, 6)):
            base[rng.randrange(len(base))] = f"n{c}"
            rows.append((1000 + 10 * k + c, " ".join(base)))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    prints = [slow_print(t or "") for _, t in rows]
    root = groups(prints)
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    want = [(rows[k][0], format(prints[k], "016x"), least[root[k]]) for k in range(len(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(v for v in least.values() if v is not None)
    assert ids.count(None) == 2  # rows without id stay
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}


def slow_sketch(text):
    """Every shingle hashed on its own with whole numbers."""
    line = b" ".join(text.encode().lower().split())
    size, top = min(12, len(line)), 1 << 64
    kept = set()
    for at in range(len(line) - size + 1 if line else 0):
        h = size
        for k, byte in enumerate(line[at : at + size]):
            h += (byte + 1) * pow(sketches.BASE, size - 1 - k, top)
        h %= top
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % top
        h = (h ^ h >> 27) * 0x94D049BB133111EB % top
        h ^= h >> 31
        if h < top // 8:
            kept.add(h)
    return kept


def test_edits(spark):
    rows = [r for r in near_rows() if r[0] not in (3, 9, None)] + [(3, "same row")]
    got = {r["doc_id"]: r for r in sketches.compare_edits(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for name, value in (("fingerprint", text), ("edited_fingerprint", changed)):
            assert base64.b64decode(row[name]).hex() == "".join(format(h, "016x") for h in sorted(slow_sketch(value)))
        for name, value in (("near_edited", changed), ("near_next", following)):
            a, b = slow_sketch(text), slow_sketch(value)
            want = len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))
            assert row[name] == pytest.approx(want)


def test_edits_of_awkward_tables(spark):
    rows = awkward()
    got = sketches.compare_edits(documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    one = sketches.compare_edits(documents(spark, [(1, "abcd")])).collect()
    assert [(r["n_chars"], r["edited_sha256"]) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest())]
    assert sketches.compare_edits(empty(spark)).collect() == []


def test_sketches_merge():
    rng = random.Random(8)
    small, large = words(rng, 400, 10**6), words(rng, 20_000, 10**6)
    both = sketches.merge(sketches.sketch(small), sketches.sketch(large))
    assert sketches.containment(sketches.sketch(small), both) == 1.0
    assert sketches.containment(sketches.sketch(small), sketches.sketch(small + " " + large)) > 0.9


def test_short_pieces_are_contained(monkeypatch):
    """Six words cut out of a long text: like it, but for those few that have no hash below the threshold."""
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)).split()
    whole = sketches.sketch(" ".join(text))
    pieces = [sketches.sketch(" ".join(text[k : k + 6])) for k in range(0, 390, 3)]
    likeness = [sketches.containment(piece, whole) for piece in pieces]
    assert {likeness[k] for k in range(130) if len(pieces[k])} == {1.0}
    assert sum(likeness) > 0.88 * 130
    merged = sketches.merge(*pieces)
    assert sketches.containment(merged, whole) == 1.0 and all(h < (1 << 64) // 8 for h in merged.tolist())
    # Texts longer than one piece of hashing give the same sketch.
    monkeypatch.setattr(sketches, "PIECE", 100)
    assert (sketches.sketch(" ".join(text)) == whole).all()


def test_rows_without_id_are_many_buckets(spark):
    rows = [(None, f"text {k} of many") for k in range(400)] + [(5, "five"), (6, "six")]
    df = documents(spark, rows)
    assert sketches._in_order(df).where("doc_id is null").select("b").distinct().count() > 8
    got = sketches.compare_edits(df).collect()
    assert len(got) == 402
    key = {t: k for t, k in df.select("text", sketches.row_key()).collect()}
    order = ["six", "five", *sorted((t for i, t in rows if i is None), key=key.get)]
    want = Counter(
        hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 402][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order)
    )
    assert Counter(r["edited_sha256"] for r in got) == want
