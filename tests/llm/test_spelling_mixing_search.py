"""Spelling variants, mixing and ranked search against brute force and SQL."""

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from helpers import awkward, documents, empty, words

from lumatable.llm import lexical, mixing, spelling

ITEMS = "item_id bigint, text string"


def plain(rows):
    return Counter(tuple(row) for row in rows)


def oracle(sql, tables):
    """The query's SQL over small tables given as (columns, rows)."""
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return Counter(con.execute(sql).fetchall())


# --- spelling ---------------------------------------------------------------


def distance(a, b):
    @lru_cache(None)
    def at(i, j):
        if not i or not j:
            return i + j
        return min(at(i - 1, j) + 1, at(i, j - 1) + 1, at(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return at(len(a), len(b))


def variants(counts, ratio=10):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and v != w and distance(v, w) == 1] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best and counts[best] >= ratio * counts[word] else None

    def root(word):
        return root(form[word]) if form[word] else word

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def vocabulary(seed, n, letters="abÿ", lengths=(2, 9)):
    rng = random.Random(seed)
    made = {"".join(rng.choice(letters) for _ in range(rng.randrange(*lengths))) for _ in range(n)}
    return {word: int(10 ** rng.uniform(0, 4)) for word in made}


@pytest.mark.parametrize("block", [7, 1000])
def test_variants_equal_brute_force(spark, block):
    counts = vocabulary(3, 150) | {"ÿ" * k: 10**k for k in range(2, 7)} | {"z" * 3000: 4, "z" * 3001: 400}
    df = spark.createDataFrame([(w, n, None) for w, n in counts.items()], "word string, n long, key string")
    got = spelling.group_variants(df, block=block, chunk=20).collect()
    assert plain(got) == Counter(variants({w: n for w, n in counts.items() if w[0] != "z"}) | {
        ("z" * 3000, "z" * 3001, "z" * 3001, 4, 1, 400), ("z" * 3001, None, "z" * 3001, 400, 1, None)})


def test_runs_find_what_brute_force_finds():
    listed = sorted(w.encode("latin-1") for w in vocabulary(5, 250, "abc", (3, 9)))
    asked = [w.encode("latin-1") for w in vocabulary(6, 200, "abcd", (3, 9))]
    found = Counter(spelling.Runs(listed).near(asked, [len(q) // 2 for q in asked]))
    want = Counter(
        (i, j) for i, q in enumerate(asked) for j, w in enumerate(listed)
        if w[: len(q) // 2] == q[: len(q) // 2] and abs(len(w) - len(q)) < 2 and distance(q, w) == 1
    )
    assert found == want


def test_vocabulary_counts_and_drops(spark):
    rng = random.Random(8)
    names = ["Grünlich", "grünlich", "TATSÄCHLICH", "tatsächlich", "neighbour", "ÀÉÿabcd", "short", "seventh"]
    rows = [(i, "".join(rng.choice([*names, "1", "éİ", "中"]) + rng.choice(" ,-中") for _ in range(60))) for i in range(80)]
    rows += [*awkward(), (None, "neighbour neighbour"), (90, "neighbour"), (90, "neighbour")]
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    want = {w: n for w, n in counts.items() if n > 1}
    assert any(len(w) == len("tatsächlich") - 1 and w[0] == "t" for w in want)
    df = documents(spark, rows)
    assert {row["word"]: row["n"] for row in spelling.vocabulary(df).collect()} == want
    assert plain(spelling.spelling_variants(df).collect()) == Counter(variants(want))
    assert spelling.spelling_variants(empty(spark)).collect() == []


# --- mixing -----------------------------------------------------------------


def mixed_documents():
    rng = random.Random(4)
    hot = [(i, words(rng, rng.randrange(60)), "en", "hot") for i in range(100, 300)]
    rest = [(i, words(rng, 30), "en", rng.choice(["a", "b", "é", "Z", None])) for i in range(300, 340)]
    tiny = [(400, "one", "en", "tiny"), (401, "", "en", "void"), (402, None, "en", "void")]
    return [(*row, *["en", "a"][len(row) - 2 :]) for row in awkward()] + hot + rest + tiny


def test_mixture_equals_sql(spark):
    rows = mixed_documents()
    got = mixing.mix_sizes(documents(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = oracle(mixing.ORACLE_SQL, {"documents": ("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", rows)})
    assert plain(got) == want
    assert mixing.mix_sizes(empty(spark)).collect() == []


def test_budgets_are_met_exactly(spark):
    rows = mixed_documents()
    got = mixing.plan_mixture(documents(spark, rows)).collect()
    total, taken, size, target = 0, Counter(), {}, {}
    for r in got:
        assert r["epochs"] * r["size"] + r["part"] <= 3 * r["size"]
        taken[r["source"]] += r["epochs"] * r["size"] + r["part"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
        total += r["size"]
    # Water filling by rounds, as the rule is written.
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    stopped = set()
    while True:
        free = total - sum(3 * size[s] for s in stopped)
        share = sum(w for s, w in weights.items() if s not in stopped)
        over = {s for s in size if s not in stopped and free * weights[s] / share > 3 * size[s]}
        if not over:
            break
        stopped |= over
    want = {s: 3 * size[s] if s in stopped else free * weights[s] / share for s in size}
    assert "tiny" in stopped and len(stopped) < len(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == math.floor(target[s] + 0.5)


def test_mixed_rows_are_what_the_plan_takes(spark):
    df = documents(spark, mixed_documents())
    plan = mixing.plan_mixture(df).cache()
    made = mixing.mixed_rows(df, plan)
    assert made.columns == [*df.columns, "epoch"]
    held = Counter()
    for row in made.collect():
        held[row["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
    want = Counter()
    for row in plan.collect():
        want[row["source"]] += row["epochs"] * row["size"] + row["part"]
    assert +held == +want


# --- ranked search ----------------------------------------------------------


def search_tables(n=400):
    rng = random.Random(6)
    rows = awkward() + [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(int(rng.paretovariate(0.6)) % 3000))) for i in range(100, 100 + n)]
    rows += [(9000 + i, "w1 w2 w3 w4 Same") for i in range(120)] + [(9500, "É éÀ_ÿ-9 SAME")] * 3
    items = [(1, "w1 W2 w3, w900 w1"), (2, "same é"), (2, "w5 w7 w9 w11 w30"), (None, "w12 unseen"), (5, ""), (6, None), (7, "!?"), (8, "unseen")]
    items += [(20 + k, " ".join(f"w{rng.randrange(1, 60)}" for _ in range(20))) for k in range(12)]
    return rows, items


def test_search_equals_sql(spark):
    rows, items = search_tables()
    df, asked = documents(spark, rows), spark.createDataFrame([(*i, None) for i in items], ITEMS + ", score int")
    columns = {"documents": ("doc_id BIGINT, text VARCHAR", rows), "benchmark": ("item_id BIGINT, text VARCHAR", items)}
    want = oracle(lexical.ORACLE_SQL, columns)
    small = lexical.search(df, asked, seeds=3, limit=25, index=lexical.build_index(df, columns=8))
    assert plain(small.collect()) == want
    assert plain(lexical.search(df, asked).collect()) == want
    assert lexical.search(empty(spark), asked).collect() == []
    assert lexical.search(df, asked.limit(0)).collect() == []


def test_bounds_hold_and_prune(spark):
    rows, items = search_tables(2000)
    texts = [t.encode() for _, t in rows if t]
    wanted = [(k, term) for k, (_, t) in enumerate(items) for term in set(lexical.terms((t or "").encode()))]
    found = [lexical.terms(t) for t in texts]
    holding = Counter(term for f in found for term in set(f) if any(term == w for _, w in wanted))
    known = lexical.Items(wanted, sum(map(bool, found)), sum(map(len, found)), holding)
    gathered = [(k, *lexical._signature(t)) for k, t in enumerate(texts)]
    truth = {k: dict(known.score(t, known.items)) for k, t in enumerate(texts)}
    pruned = pairs = 0
    for keys, counts, width, bits in lexical._blocks([g for g in gathered if g[1]], 64):
        keys = np.frombuffer(keys, "<i8")
        bounds = known.bounds(np.frombuffer(counts, "<i8"), width, bits)
        for i, item in enumerate(known.items):
            best = sorted((t[item] for t in truth.values()), reverse=True)[49]
            for k, bound in zip(keys, bounds[i], strict=True):
                assert bound >= truth[k][item]
                pruned += bound < best
                pairs += 1
    assert pruned > pairs / 2
