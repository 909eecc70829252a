"""Language of whole texts from word labels of a conditional random field."""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lumatable.llm import crf
from lumatable.llm.common import worker_state

WORD = re.compile(r"[^\W\d_]+")
# Letters with their combining marks, which the class above leaves out; slower, so only where a text has marks.
MARKED = regex.compile(r"(?:\p{L}\p{M}*+)+")
MARK = regex.compile(r"\p{M}")
PIECE = 20  # letters of a chain position: runs of scripts without blanks are cut into so many
CHAIN = 256  # words; a line is cut there
AROUND = 16  # words before and after a cut that its chain sees besides its own
BLOCK = 100_000  # words labelled together, for up to 64 languages
UNKNOWN = "und"


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def line_words(line: str, marked: bool) -> list[str]:
    """The words of a line; longer runs of letters as pieces, all of them."""
    words = MARKED.findall(line) if marked else WORD.findall(line)
    if words and max(map(len, words)) > PIECE:
        words = [word[i : i + PIECE] for word in words for i in range(0, len(word), PIECE)]
    return words


def text_chains(text: str) -> list[tuple[list[str], int, int]]:
    """(words, first, last) of each line, A-Z and others lower-cased.

    Long lines are cut; a chain then holds words around its own, which stand at first to last - 1, so
    that a change of language at a cut is seen like any other.
    """
    chains = []
    text = text.lower()
    marked = not text.isascii() and MARK.search(text) is not None
    for line in text.split("\n"):
        words = line_words(line, marked)
        for i in range(0, len(words), CHAIN):
            low, high = max(0, i - AROUND), min(len(words), i + CHAIN + AROUND)
            chains.append((words[low:high], i - low, min(i + CHAIN, len(words)) - low))
    return chains


def _drawn_text(max_chars: int, seed: int) -> Column:
    """The text, or of a longer one `max_chars` from a hashed place on (from its first letter, if none is there)."""
    text = F.col("text")
    at = F.pmod(F.xxhash64(text, F.lit(seed + 1)), F.length(text) - max_chars + 1) + 1
    span = F.substring(text, at.cast("int"), F.lit(max_chars))
    first = F.regexp_instr(text, F.lit(r"\p{L}"))
    lettered = F.when(span.rlike(r"\p{L}"), span).otherwise(F.substring(text, first, F.lit(max_chars)))
    return F.when(F.length(text) <= max_chars, text).otherwise(lettered)


def sample(df: DataFrame, per_label: int = 100, max_labels: int = 1000, max_chars: int = 60_000, seed: int = 3) -> tuple[list[str], list[Row]]:
    """Languages, and different texts of each: all if there are at most `per_label`, about as many if there are more.

    Copies count once, both in the share drawn and in the draw, so that no group of copies takes its language's
    place. Texts are drawn by a hash; longer ones than `max_chars` give a span from anywhere in them, a shorter one
    if there are over four languages, as fitting holds words x languages in memory.
    """
    known = df.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    # Rows of one text meet in the tasks that read them; only hashes are dealt out.
    texts = known.groupBy("lang", F.xxhash64("text", F.lit(seed)).alias("draw")).agg(F.count("*").alias("copies"))
    sizes = texts.groupBy("lang").agg(F.sum("copies").alias("rows"), F.count("*").alias("texts"))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(max_labels).collect()
    labels = sorted(row["lang"] for row in sizes)
    if not labels:
        return [], []
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    wanted = F.lit(False)
    for row in sizes:
        bound = max(1, int(min(1.0, per_label / row["texts"]) * (1 << 30)))
        wanted |= (F.col("lang") == row["lang"]) & (draw < bound)
    span = max(min(max_chars, 1_000), int(max_chars / max(1.0, len(labels) / 4) ** 2))
    text = F.when(F.length("text") <= max_chars, F.col("text")).otherwise(_drawn_text(span, seed))
    return labels, known.where(wanted).select("lang", text.alias("text")).dropDuplicates(["lang", "text"]).collect()


def train(df: DataFrame, per_label: int = 100, max_labels: int = 1000, max_chars: int = 60_000, seed: int = 3) -> crf.Model:
    """Fit the model on a bounded sample: about `per_label` different texts, of none more than `max_chars`, per language.

    `max_labels` bounds the sample too: values of `lang` beyond so many, the rarest, are not learned. Every word of a line carries its document's
    language; lines of the languages are mixed into chains, so that changes of language are learned as well.
    """
    labels, drawn = sample(df, per_label, max_labels, max_chars, seed)
    untrained = crf.Model([], np.zeros((crf.hashed_features(0), 0), np.float32), np.zeros((0, 0), np.float32), [])
    if not labels:
        return untrained
    rng = random.Random(seed)
    lines = [[] for _ in labels]
    for row in sorted(drawn, key=lambda r: (r["lang"], r["text"])):
        lines[labels.index(row["lang"])] += [words[low:high] for words, low, high in text_chains(row["text"])]
    present = [k for k, own in enumerate(lines) if own]
    if not present:
        return untrained
    for own in lines:
        rng.shuffle(own)
    chains, left = [], [list(own) for own in lines]
    tag = rng.choice(present)
    while any(left):
        words, tags = [], []
        while len(words) < CHAIN and any(left):
            if not left[tag] or rng.random() < 0.3:
                tag = rng.choice([k for k in present if left[k]])
            line = left[tag].pop()
            words += line
            tags += [tag] * len(line)
        chains.append((words, tags))
    return crf.fit(chains, labels)


class Labeller:
    """Label probabilities of whole texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: crf.Model, memo: int):
        self.model, self.memo = model, memo
        self.moves = np.exp(model.moves - model.moves.max(initial=-1e9)).astype(np.float32)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.labels)), dtype=np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Factors of the words, computing those not seen yet."""
        if len(self.known) > self.memo:
            self.reset()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            scores = crf.word_scores(fresh, self.model.weights, self.model.lexicons)
            scores = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -40)).astype(np.float32)
            at = len(self.known)
            if at + len(fresh) > len(self.table):
                grown = np.empty((2 * (at + len(fresh)), scores.shape[1]), dtype=np.float32)
                grown[:at] = self.table[:at]
                self.table = grown
            self.table[at : at + len(fresh)] = scores
            self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]

    def shares(self, texts: list[str]) -> np.ndarray:
        """Share of each label in the words of each text; zeros where there is no word."""
        sums = np.zeros((len(texts), len(self.model.labels)))
        block = max(2 * CHAIN, BLOCK * 64 // max(64, len(self.model.labels)))
        words: list[str] = []
        chains: list[tuple[int, int, int, int]] = []  # (owner, words, first, last)

        def flush() -> None:
            nonlocal words, chains
            if words:
                owner, size, first, last = np.array(chains, dtype=np.int64).T
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                gamma = crf.forward_backward(self.rows(words), starts, size, self.moves)
                place = np.arange(len(words)) - np.repeat(starts, size)
                gamma[(place < np.repeat(first, size)) | (place >= np.repeat(last, size))] = 0  # seen, but another chain's
                np.add.at(sums, owner, np.add.reduceat(gamma, starts, axis=0))
            words, chains = [], []

        for k, text in enumerate(texts):
            for chain, first, last in text_chains(text):
                words += chain
                chains.append((k, len(chain), first, last))
                if len(words) >= block:
                    flush()
        flush()
        total = sums.sum(axis=1, keepdims=True)
        return np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)


def predictor(df: DataFrame, model: crf.Model, memo: int = 300_000):
    """Column function text -> struct(lang, score), with the model broadcast (its size is fixed)."""
    run = uuid.uuid4().hex  # tells this call's model from another's
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = worker_state(("labeller", run, memo), lambda: Labeller(shared.value, memo))
        labels = labeller.model.labels
        for series in batches:
            texts = [text or "" for text in series]
            lettered = np.array([any(map(str.isalpha, text)) for text in texts], dtype=bool)
            if not labels or not len(texts):
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
                continue
            shares = labeller.shares(texts)
            lettered &= shares.sum(axis=1) > 0
            best = shares.argmax(axis=1)
            score = np.where(lettered, np.clip(shares[np.arange(len(texts)), best], 0, 1), 0.0)
            lang = [labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            yield pd.DataFrame({"lang": lang, "score": score})

    return predict


def identify(df: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """Language and share of the words that have it, for each whole text.

    Learns from `df`'s own labelled texts that are not held out, unless a model is given. Null texts and texts without a
    letter are `und` with score 0, as is everything if there is nothing to learn from; equal
    shares go to the first label in order; repeated rows are labelled each; an empty table gives
    no rows; other columns are ignored.
    """
    predict = predictor(df, model or train(df))
    return df.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"
    )


def keep_identified(df: DataFrame, model: crf.Model | None = None, min_score: float = 0.3) -> DataFrame:
    """`df` without the documents whose language is unknown or holds less than `min_score` of the words."""
    predict = predictor(df, model or train(df))
    marked = df.withColumn("_llm_lang", predict(F.col("text")))
    return marked.where((F.col("_llm_lang.lang") != UNKNOWN) & (F.col("_llm_lang.score") >= min_score)).select(*df.columns)
