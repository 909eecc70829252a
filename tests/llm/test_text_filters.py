"""Language identification, personal data, decontamination and pages against brute force."""

import hashlib
import random
import re
import time
from itertools import product

import numpy as np
import pytest
from helpers import awkward, documents, empty, words
from pyspark.sql import functions as F

from lumatable.llm import crf, decontaminate, html_text, language_id, pii

SF = "/root/testdata/sf0.01"


def test_posteriors_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    emit, moves = rng.random((11, 3)) + 0.1, rng.random((3, 3)) + 0.1
    starts, lengths = np.array([0, 4, 5]), np.array([4, 1, 6])
    gamma, expected = crf.forward_backward(emit, starts, lengths, moves, pairs=True)
    pairs = np.zeros((3, 3))
    for at, n in zip(starts, lengths, strict=True):
        total, want, own = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            weight = np.prod([emit[at + k, tag] for k, tag in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += weight
            for k, tag in enumerate(path):
                want[k, tag] += weight
            for a, b in zip(path, path[1:], strict=False):
                own[a, b] += weight
        assert np.allclose(gamma[at : at + n], want / total)
        pairs += own / total
    assert np.allclose(expected, pairs)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, per_label=60)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    rows = awkward() + [(20, "123 ... 456"), (21, "²½"), (22, "x " * 50_000)]
    frame = documents(spark, rows)
    out = language_id.identify(frame, model).collect()
    for (doc_id, text), r in zip(rows, out, strict=True):
        lettered = any(c.isalpha() for c in text or "")
        assert r["doc_id"] == doc_id
        assert (r["lang_pred"] == "und") == (not lettered)
        assert 0 <= r["score"] <= 1
    kept = language_id.keep_identified(frame, model)
    assert kept.columns == frame.columns
    assert language_id.keep_identified(docs, model).count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    # Words of two languages in one text are told apart.
    de = docs.where("lang = 'de'").orderBy("doc_id").first()["text"].split("\n")[0]
    en = docs.where("lang = 'en'").orderBy("doc_id").first()["text"].split("\n")[0]
    mixed = language_id.Labeller(model, 1000).shares([f"{en}\n{de}"])[0]
    expected = len(de.split()) / (len(de.split()) + len(en.split()))
    assert abs(mixed[model.labels.index("de")] - expected) < 0.25
    nothing = language_id.identify(empty(spark)).collect()
    assert nothing == []
    unlabelled = documents(spark, [(1, "some words")]).withColumn("lang", F.lit(None).cast("string"))
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(unlabelled).collect()] == [("und", 0.0)]


def test_all_letters_of_long_runs_and_marks_count():
    """Hindi and Thai keep their marks; a clause without blanks is several chain positions, all of them seen."""
    (hindi, *_), = language_id.text_chains("हिन्दी में लिखा")
    assert hindi == ["हिन्दी", "में", "लिखा"]
    (thai, *_), = language_id.text_chains("สวัสดี ชาวโลก")
    assert thai == ["สวัสดี", "ชาวโลก"]
    run = "a" * 40 + "b" * 40
    (first, *_), (other, *_) = language_id.text_chains(run + "zzzz"), language_id.text_chains(run[:-1] + "czzzz")
    assert "".join(first[0]) == run + "zzzz" and max(map(len, first[0])) == language_id.PIECE
    assert [crf.features(w, []) for w in first[0]] != [crf.features(w, []) for w in other[0]]
    assert crf.features("x" * 19 + "q", []) != crf.features("x" * 18 + "qx", [])


def test_long_lines_are_labelled_like_whole_ones(spark, monkeypatch):
    """Pieces of a line see the words around them: posteriors are those of the uncut chain."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    model = language_id.train(docs, per_label=30)
    text = " ".join(r["text"].replace("\n", " ")[:400] for r in docs.orderBy("doc_id").limit(12).collect())
    assert len(text.split()) > 600
    cut = language_id.Labeller(model, 5000).shares([text])
    monkeypatch.setattr(language_id, "CHAIN", 10**6)
    whole = language_id.Labeller(model, 5000).shares([text])
    assert np.allclose(cut, whole, atol=1e-4)


def test_many_languages_are_learned(spark):
    """More languages than the hashed features were made for: none is left out."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        own = rng.sample([a + b for a in letters for b in letters], 12)
        for _ in range(9):
            rows.append((len(rows), " ".join("".join(rng.choice(own) for _ in range(3)) for _ in range(30)), f"l{k:02d}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df)
    got = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert crf.hashed_features(70) == 1 << 15
    assert set(model.labels) == {r["lang"] for r in got if not r["held_out"]} and len(model.labels) > 66
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["held_out"]]) > 0.9


def test_copies_and_long_texts_hide_no_language(spark):
    rng = random.Random(9)

    def prose(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))

    rare = [(k, prose("abcde", 30), "aa") for k in range(30)] + [(100 + k, prose("lmnop", 30), "bb") for k in range(60)]
    long = [(200 + k, prose("stuvw", 12_000), "cc") for k in range(6)]
    hot = spark.range(1000, 61_000).select(F.col("id").alias("doc_id"), F.lit(rare[0][1]).alias("text"), F.lit("aa").alias("lang"))
    frame = spark.createDataFrame(rare + long, "doc_id bigint, text string, lang string").union(hot)
    assert all(len(text) > 50_000 for _, text, _ in long)
    model = language_id.train(frame, max_chars=3_000)
    got = language_id.identify(frame, model).join(frame.select("doc_id", "lang"), "doc_id")
    assert got.where("lang != lang_pred").count() == 0
    # The only letter of a long text is found, and the sample stays bounded.
    odd = spark.createDataFrame([(k, "1" * 9_000 + f" word{k}", "dd") for k in range(400)], "doc_id bigint, text string, lang string")
    labels, texts = language_id.sample(odd, max_chars=100)
    assert labels == ["dd"] and 50 < len(texts) < 160
    assert all("word" in r["text"] and len(r["text"]) <= 100 for r in texts)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{a}:{z}" for a, _, kind, z in sorted(out)]


def test_fixed_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x_y@d-e.f.g", "..d@e.f", "@", ".", "-", " ", "1", "25", "255", "256", "1.2.3.4", "1.2.3.4.5.6.7.8", "+", "(", "é\U0001f600",
            "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (643) 555-2043", "0000255.0.0.1", "\n", "%", "12345678901234567890", "a"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))) for k in range(600)]
    # Long runs, short enough for the plain patterns below, which take quadratic time.
    rows += [(1000 + i, t) for i, t in enumerate(["a" * 900, "1" * 900, "1." * 900, "a@b" + ".c" * 900, "x@" * 900, "+1" * 900, "1 " * 900 + "@"])]
    rows += [(None, "x@y.z"), (2000, None), (2001, ""), (5, rows[5][1])]
    got = {}
    for r in pii.find_personal_data(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        want = base_spans(text or "")
        for r in got[doc_id]:
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:200]
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in want) for k, _ in BASE]
            assert set(want) <= set(r["spans"].split(",")) or not want
    assert sum(map(len, got.values())) == len(rows)
    long = [(1, "a" * 200_000), (2, "1." * 100_000), (3, "a@b" + ".c" * 50_000), (4, "x@" * 50_000), (5, "1 " * 100_000 + "@")]
    counts = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"]) for r in pii.find_personal_data(documents(spark, long)).collect()}
    assert counts == {1: (0, 0, 0), 2: (0, 25_000, 0), 3: (1, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}
    assert pii.find_personal_data(empty(spark)).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        rows.append((k, f"{words(rng, 5)} call me at +1 (64{k % 10}) 555-20{k:02d} {words(rng, 5)} server address 10.0.0.{k} ok"))
    hidden = [(100, "please call me at 555-123-4567 now"), (101, "the server address fe80:1:2:3:4 is"), (102, "version 3.1 at 12:30")]
    again = [(103, "again 555-123-4567 elsewhere")]
    frame = documents(spark, rows + hidden + again)
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    assert got[100] == "phone:18:30" and got[103] == "phone:6:18"
    assert got[101] == "ip:19:31"
    assert got[102] == ""
    for doc_id, text in rows:
        assert got[doc_id].split(",") == base_spans(text)
    clean = pii.redact(frame)
    assert clean.columns == frame.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[100] == ("please call me at [phone] now", 29)
    assert texts[102] == ("version 3.1 at 12:30", 0)
    assert not any(base_spans(t) for t, _ in texts.values())


def test_contexts_are_judged_by_tokens_of_the_kind(spark):
    rng = random.Random(8)
    rows = []
    for k in range(20):  # half of the numbers international, half national, and plain numbers between them
        rows.append((k, f"{words(rng, 3)} phone: +1 (64{k % 10}) 555-20{k:02d}"))
        rows.append((100 + k, f"{words(rng, 3)} phone: 555-123-45{k:02d}"))
        rows += [(200 + 3 * k + i, f"phone: {1990 + 3 * k + i} or phone: {3 * k + i}x") for i in range(3)]
        rows.append((300 + k, f"reach it by 10.0.0.{k} ok"))  # one context of two kinds
        rows.append((400 + k, f"reach it by +1 (65{k % 10}) 555-30{k:02d} ok"))
        rows.append((500 + k, f"order no {10_000_000 + k} came"))
        rows.append((520 + k, "pay card 4111111111111111 or" if k == 3 else f"pay card {4111111111111100 + k} or"))
        rows.append((540 + k, f"pay card {next(n for n in range(10**15 + 50 * k, 10**16) if luhn(str(n)))} or"))
    rows += [(600, "reach it by fe80:1:2:3:4 or so"), (601, "reach it by 555-987-6543 or so")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    for doc_id, text in rows:
        if 100 <= doc_id < 120:
            at = text.index("phone: ") + 7
            assert got[doc_id] == f"phone:{at}:{at + 12}"
        elif doc_id < 600:
            assert [s for s in got[doc_id].split(",") if s] == base_spans(text)
    assert got[600] == "ip:12:24" and got[601] == "phone:12:24"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        grams = plain_words(item_text)
        m = min(10, len(grams))
        for g in {tuple(grams[i : i + m]) for i in range(len(grams) - m + 1)} if m else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == g:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("held", [decontaminate.HELD, 7])
def test_decontamination(spark, held):
    rng = random.Random(6)
    items = [(k, words(rng, n, 60)) for k, n in enumerate((14, 10, 30, 3, 1, 9, 0))] + [(20, None), (10, words(rng, 12, 60)), (21, "é ß 42 Test's end")]
    items[4] = (4, "zebra")
    rows = [(i, t) for i, t in awkward() if i != 7]
    for k in range(40):
        parts = [words(rng, rng.randrange(9), 60), rng.choice(items)[1] or "", words(rng, 3, 60), (rng.choice(items)[1] or "").upper()]
        rows.append((100 + k, ", ".join(parts)))
    rows += [(150, "ZEBRA"), (151, "É ß 42: test s END"), (151, "é ß 42: test s END"), (152, rows[-1][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    frame = documents(spark, rows)
    got = decontaminate.find_contamination(frame, table, held=held).collect()
    want = [(i, *brute_hits(t, items)) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = decontaminate.remove_contaminated(frame, table, held=held)
    assert kept.columns == frame.columns
    clean = [r for r, w in zip(rows, want, strict=True) if not w[-1]]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, clean))
    cut = decontaminate.remove_contaminated(frame, table, spans=True, held=held).collect()
    assert len(cut) == len(rows)
    lost = {i: n_hit for i, _, n_hit, *_ in want if i is not None}
    for r in cut:
        if r["doc_id"] is not None and r["doc_id"] >= 100 and r["doc_id"] < 140:
            text = dict(rows)[r["doc_id"]]
            assert len(plain_words(r["text"])) == len(plain_words(text)) - lost[r["doc_id"]]
    none = decontaminate.find_contamination(frame, table.limit(0), held=held)
    assert {r["n_hit"] for r in none.collect()} == {0}
    assert decontaminate.find_contamination(empty(spark), table, held=held).collect() == []


def test_many_test_windows_move_only_hits(spark, capsys):
    """100,000 n-grams: windows meet a broadcast of hashes, and only found ones are exchanged."""
    rng = random.Random(21)
    texts = [words(rng, 109, 10**6) for _ in range(1_000)]
    table = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(4)
    held = [(k, words(rng, 200, 10**6)) for k in range(50)]
    rows = held + [(100 + k, f"{words(rng, 30, 10**6)} {' '.join(texts[k].split()[5:25])} tail") for k in range(20)]
    rows += [(200, " ".join(texts[0].split()[:9])), (201, " ".join(texts[0].split()[:10]))]
    df = documents(spark, rows)
    matcher = decontaminate.Matcher(table)
    assert matcher.hashes.count() == 100_000 and matcher.parts == 1
    marked = matcher.mark(df)
    assert marked.count() == len(rows) + 20 * 11 + 1
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.find_contamination(df, table).collect()}
    assert got == {k: (0, 0) for k, _ in held} | {100 + k: (20, 1) for k in range(20)} | {200: (0, 0), 201: (10, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(df, table).collect()) == [*range(50), 200]


PAGES = [
    (None, ""),
    ("", ""),
    ("plain text, no tags", "plain text, no tags"),
    ("<p>a &amp; b&nbsp; c<br>d<p>second", "a & b c d\nsecond"),
    (
        "<body><div class='top-nav'><a href=/>Home</a></div><div id=x><div class='post-content'><h2>Head</h2><p>One, two, three, and more.</p>"
        "<div class=ad>Buy, buy, buy now, or later, or never.</div><p>Last one, with <a href=1>a link</a>.</p></div><div class=sidebar><p>Side, side.</p></div>"
        "<div id=comments><p>Nice, nice, very, very nice, truly nice.</p></div></div><footer>foot</footer></body>",
        "Head\nOne, two, three, and more.\nLast one, with a link.",
    ),
    (
        "<article><h1>T</h1><section><p>Part one, which is long, and longer still.</p></section><section><p>Two.</p></section>"
        "<form><p>Your name, please, and address, too.</p><input></form><script>var a='<p>no</p>';</script></article><aside>x</aside>",
        "T\nPart one, which is long, and longer still.\nTwo.",
    ),
    ("<div>" * 3000 + "deep text, here" + "</div>" * 3000, "deep text, here"),
    ("<article><p>x</p><!-- <p>no</p>", "x"),
    ("<nav><ul><li><a href=1>only</a></li></ul></nav>", ""),
]


def test_end_tags_reach_any_depth():
    loose = "<font><b><span>" * 50
    text = "The article, which is long, and stays."
    assert html_text.main_text(f"<nav>{loose}menu</nav><div><p>{text}</p></div>") == text
    assert html_text.main_text(f"<header>{loose}top</header><article><p>{text}</p>{loose}</article><div>foot</div>") == text


def test_class_words_and_wrappers_lose_no_article():
    lines = [f"Line {k} of the article, which is long enough, and has commas, as prose has them." for k in range(4)]
    article = "".join(f"<p>{line}</p>" for line in lines)
    side = "<div class=sidebar><p>Side, side.</p></div><div id=comments><p>Nice, very nice, and true.</p></div>"
    foot = "<div class=footer><p>All rights reserved, of course.</p></div>"
    for names in ("container has-sidebar", "elementor-widget-wrap", "layout right-rail", "social-history"):
        page = f"<body><div class='{names}'><div>{article}</div>{side}</div>{foot}</body>"
        assert html_text.main_text(page) == "\n".join(lines), names
    wrapped = "".join("<div>" * 5 + f"<p>{line}</p>" + "</div>" * 5 for line in lines)
    assert html_text.main_text(f"<body><div>{wrapped}</div>{foot}</body>") == "\n".join(lines)


PROSE = "A sentence of the article, long enough to count, with commas, and more words than furniture has. "


def test_forms_around_pages_labels_and_formulas():
    """A page inside one form keeps its article; labels and formulas in it are text; a small form is dropped."""
    page = f"<body><form id='aspnetForm' action='x'><div><h1>Title</h1><p>{PROSE * 3}</p><p>{PROSE * 2}</p></div></form></body>"
    assert html_text.main_text(page) == "\n".join(["Title", (PROSE * 3).strip(), (PROSE * 2).strip()])
    article = f"<article><p>{PROSE * 3}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>\\LaTeX</annotation></math> and <label>this label</label> be.</p>"
    article += "<form><fieldset><label>Your mail</label><input><button>Send</button></fieldset></form></article>"
    assert html_text.main_text(article) == f"{(PROSE * 3).strip()}\nLet x=1 and this label be."


@pytest.mark.parametrize("page", [
    "<b>" * 50_000 + "<p>x</p>" * 50_000,
    "<p><select>" + "<b>" * 50_000 + "<hr>" * 50_000,
    "<b>" * 50_000 + "</div>x" * 50_000,
    "<ul><li>" * 20_000 + "<b>" * 30_000 + "<li>" * 30_000,
])
def test_broken_pages_take_linear_time(page):
    started = time.perf_counter()
    html_text.Page(page)
    assert time.perf_counter() - started < 4


def test_long_words_and_tokens_are_whole(spark):
    """A context word of any length tells contexts apart; an identifier of any length is one."""
    long = "w" * 90
    rows = [(k, f"{long}a mail: me{k}@x.org and {long}b code {'7' * 3}{k:02d}{'5' * 5}") for k in range(12)]
    rows += [(50 + k, f"note {long}a mail: {'n' * 150}{k}@host ok") for k in range(2)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert [got[50 + k] for k in range(2)] == [f"email:{5 + 92 + 6}:{5 + 92 + 6 + 151 + 5}"] * 2


def test_pages(spark):
    rows = [(k, f"u{k}", h, 1) for k, (h, _) in enumerate(PAGES)] + [(2, "u2", PAGES[2][0], 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract(frame).collect()))
    want = sorted((k, u, PAGES[k][1], len(PAGES[k][1])) for k, u, _, _ in rows)
    assert got == want
    assert html_text.extract(frame.limit(0)).collect() == []
