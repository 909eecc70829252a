"""Spelling variants: words one edit apart, found by scanning the sorted vocabulary.

The scan is the edit-distance matrix of a word against a sorted list. Neighbours in the list share
the matrix rows of their common prefix, so a row belongs to a run of the list, is worked out once for
the run, and a run whose row holds no value below two is skipped whole. Rows are cut to the band of
one edit around the diagonal.

One edit leaves a half of the word as it is. The scan of the list keeps the first half and edits the
second; the scan of the list of reversed words edits the other one. Each scan thus starts inside the
run of the half it keeps, and only goes to the blocks of the list that hold this run.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatable.llm.common import materialize, shuffle_partitions

BLOCK = 1 << 16  # words of the sorted list in one block
CHUNK = 1 << 13  # words looked up at once inside a block
HELD = 400_000  # words a task counts before it passes them on
FAR = 2  # stands for every distance above one


def _words(text: str, prefix: bytes, pattern: re.Pattern, least: int, drop: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a text, one byte per letter; other characters become question marks."""
    for run, count in Counter(pattern.findall(text.encode("latin-1", "replace").lower())).items():
        written = run if run.isascii() else run.decode("latin-1").encode()
        drawn = zlib.crc32(written, zlib.crc32(prefix))
        if drop and drawn % drop == 0:
            if len(run) == least:
                continue
            at = drawn % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, count


def vocabulary(df: DataFrame, least: int = 7, occurrences: int = 2, drop: int = 31) -> DataFrame:
    """(word, n): runs of letters of all texts with A-Z lower-cased, and how often each occurs.

    `drop` plants misspellings: a run loses one letter in those documents where it divides the checksum
    of `<doc_id>:<run>` (zero: never). Words are counted per task before the shuffle. Null texts have
    no words, a null id is written as nothing.
    """
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [word.decode("latin-1") for word in held]
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
                for word, n in _words(text.as_py(), f"{name}:".encode(), pattern, least, drop):
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    texts = df.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Runs:
    """The sorted list as levels of runs: a run of level d is a stretch of words with the same first d letters.

    A new run begins where the prefix shared with the word before is shorter than d.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.levels = []  # per depth: first sub-run and number of sub-runs of each run, their keys, and the word that ends there
        length = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(length)[:-1]]) if words else np.zeros(0, np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        here, run, runs = np.arange(len(words)), np.zeros(len(words), np.int64), 1
        depth = 0
        while True:
            ends = np.full(runs, -1, np.int64)
            done = length[here] == depth
            ends[run[done]] = here[done]
            here, run = here[~done], run[~done]
            keys = (run << 8) | letters[starts[here] + depth]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            below = keys[new]
            count = np.bincount(below >> 8, minlength=runs)
            self.levels.append((np.cumsum(count) - count, count, below, ends))
            if not len(here):
                break
            run, runs, depth = np.cumsum(new) - 1, len(below), depth + 1

    def near(self, queries: list[bytes], kept: list[int]) -> Iterator[tuple[int, int]]:
        """(query, word) one edit apart where the word begins with the `kept` first letters of the query.

        All queries walk down together. A state is (query, run, three matrix values around the
        diagonal of the row that the run's words share).
        """
        length = np.fromiter(map(len, queries), np.int64, len(queries))
        width = int(length.max(initial=0)) + 3
        starts = np.concatenate([[0], np.cumsum(length + 3)[:-1]])
        letters = np.frombuffer(b"".join(q + b"\0\0\0" for q in queries), np.uint8).astype(np.int64)
        free = np.array(kept, np.int64)  # depth from which edits are allowed
        query, run = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        left, mid, right = (np.full(len(queries), v, np.int8) for v in (1, 0, 1))
        for depth, (first, count, keys, ends) in enumerate(self.levels[:width]):
            if not len(query):
                return
            # Words that end here: the matrix value in the query's last column is their distance.
            over = length[query] - depth
            distance = np.where(over == 0, mid, np.where(over == -1, left, np.where(over == 1, right, FAR)))
            ended = (ends[run] >= 0) & (distance == 1) & (depth >= free[query])
            yield from zip(query[ended].tolist(), ends[run[ended]].tolist(), strict=True)
            if not len(keys):
                return

            at = starts[query] + depth
            frozen = depth < free[query]
            wide = ~frozen & (np.minimum(np.minimum(left, mid), right) == 0)
            # Where an edit is left every sub-run is looked at; elsewhere only those whose letter keeps a value at one.
            number = count[run[wide]]
            spread = np.repeat(np.flatnonzero(wide), number)
            inside = np.arange(len(spread)) - np.repeat(np.cumsum(number) - number, number)
            states, targets = [spread], [first[run[spread]] + inside]
            straight = ~wide & (frozen | (mid == 1))
            before = ~wide & ~frozen & (left == 1)
            after = ~wide & ~frozen & (right == 1)
            if depth:
                before &= ~(straight & (letters[at - 1] == letters[at]))
            after &= ~(straight & (letters[at + 1] == letters[at]))
            after &= ~(before & (letters[at + 1] == letters[at - 1]))
            for chosen, offset in ((straight, 0), (before, -1), (after, 1)):
                chosen = np.flatnonzero(chosen)
                wanted = (run[chosen] << 8) | letters[at[chosen] + offset]
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                same = keys[found] == wanted
                states.append(chosen[same])
                targets.append(found[same])
            state, run = np.concatenate(states), np.concatenate(targets)

            letter, at = keys[run] & 255, at[state]
            query, frozen = query[state], frozen[state]
            old_left, old_mid, old_right = left[state], mid[state], right[state]
            left = np.minimum(old_left + (letter != letters[at - 1]), old_mid + 1)
            mid = np.minimum(np.minimum(old_mid + (letter != letters[at]), old_right + 1), left + 1)
            right = np.minimum(old_right + (letter != letters[at + 1]), mid + 1)
            left, mid, right = np.where(frozen, 1, left), np.where(frozen, 0, mid), np.where(frozen, 1, right)
            over = length[query] - depth - 1  # columns beyond the query's end do not exist
            mid, right = np.where(over < 0, FAR, mid), np.where(over < 1, FAR, right)
            alive = np.minimum(np.minimum(left, mid), right) <= 1
            query, run = query[alive], run[alive]
            left, mid, right = (np.minimum(v[alive], FAR).astype(np.int8) for v in (left, mid, right))


def _after(prefix: bytes) -> bytes | None:
    """The least string above all that begin with the prefix."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def _kept(word: bytes, reverse: bool) -> int:
    half = len(word) // 2
    return len(word) - half if reverse else half


def _scan(words: DataFrame, reverse: bool, block: int, chunk: int, total: int) -> DataFrame:
    """(word, n_near, near_n, near) from one scan; `near` is the commonest near word, its ties broken by order."""
    spark = words.sparkSession
    blocks = max(shuffle_partitions(spark), -(-total // block))
    key = F.encode(F.reverse("word") if reverse else F.col("word"), "ISO-8859-1")
    placed = materialize(
        words.select(key.alias("key"), "n")
        .repartitionByRange(blocks, "key")
        .sortWithinPartitions("key")
        .withColumn("block", F.spark_partition_id()),
        "spelling-list",
    )
    # One row per block.
    firsts = sorted((bytes(row["first"]), row["block"]) for row in placed.groupBy("block").agg(F.min("key").alias("first")).collect())
    bounds, names = [first for first, _ in firsts], [name for _, name in firsts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n, own in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "block")), strict=True):
                prefix = word[: _kept(word, reverse)]
                after = _after(prefix)
                low = max(bisect_right(bounds, prefix) - 1, 0)
                high = len(bounds) if after is None else bisect_left(bounds, after)
                out.extend((names[k], names[k] != own, word, n) for k in range(low, high))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int32(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "guest", "key", "n"]
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, counts, runs = None, [], [], None

        def answer(queries: list[bytes]) -> pa.RecordBatch:
            best: dict[int, tuple] = {}
            for q, w in runs.near(queries, [_kept(x, reverse) for x in queries]):
                query, word = queries[q], members[w]
                half = len(query) // 2
                if reverse and word[-half:] == query[-half:]:
                    continue  # the other scan finds it
                word = word[::-1] if reverse else word
                number, n, least = best.get(q, (0, 0, b""))
                better = counts[w] > n or (counts[w] == n and word < least)
                best[q] = (number + 1, counts[w], word) if better else (number + 1, n, least)
            rows = [
                ((queries[q][::-1] if reverse else queries[q]).decode("latin-1"), number, n, word.decode("latin-1"))
                for q, (number, n, word) in best.items()
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "near_n", "near"]
            )

        def answers(queries: list[bytes]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(queries), chunk):
                yield answer(queries[at : at + chunk])

        guests: list[bytes] = []
        for batch in batches:
            for block_id, guest, word, n in zip(*(batch.column(c).to_pylist() for c in ("block", "guest", "key", "n")), strict=True):
                if block_id != current or (guest and runs is None):
                    if runs is None and members:
                        runs = Runs(members)
                        yield from answers(members)
                    if block_id != current:
                        if runs is not None:
                            yield from answers(guests)
                        current, members, counts, runs, guests = block_id, [], [], None, []
                if guest:
                    if runs is not None:  # a block without members has nothing near
                        guests.append(word)
                else:
                    members.append(word)
                    counts.append(n)
            if len(guests) >= chunk:
                yield from answers(guests)
                guests = []
        if runs is None and members:
            runs = Runs(members)
            yield from answers(members)
        if runs is not None:
            yield from answers(guests)

    routed = placed.mapInArrow(route, "block int, guest boolean, key binary, n long")
    # By range: hashes of block numbers would put several blocks into one task and none into others.
    dealt = routed.repartitionByRange(blocks, "block").sortWithinPartitions("block", "guest", "key")
    return dealt.mapInArrow(search, "word string, n_near long, near_n long, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached over forms. Each round doubles the steps taken.

    Counts grow along forms, so there are no circles.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(
            at.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "spelling-roots",
        )
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = 10, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Form and root of each word of a vocabulary (word, n), one row per word.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. A word's
    form is its commonest near word (of equally common ones the first in code-point order) if that is
    at least `ratio` (above one) times as common, else null; its root is where forms end. Words have
    letters up to U+00FF and two of them at least; an empty vocabulary gives no rows.

    The list is cut by range into blocks of about `block` words; a word visits the blocks that hold the
    run of its kept half, mostly one or two. Only the best near word and their number leave a block.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    total = words.count()
    found = _scan(words, False, block, chunk, total).unionByName(_scan(words, True, block, chunk, total))
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    common = -F.col("best.less") >= ratio * F.col("n")
    formed = materialize(
        words.join(best, "word", "left").select(
            "word",
            F.when(common, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(common, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-near",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(df: DataFrame) -> DataFrame:
    """Variants among the words of all texts of `documents`: `vocabulary`, then `group_variants`."""
    return group_variants(vocabulary(df))
