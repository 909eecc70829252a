"""Packing of tokenised documents into as few sequences as possible, by bin completion.

The plan needs only how many pieces have each length: a histogram of at most `capacity` rows,
whatever the size of the table. Bin completion runs on it and gives patterns (a multiset of lengths)
with multiplicities; each piece then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lumatable.llm.common import content, materialize, worker_state

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
# The vocabulary's rules never look across these blanks, nor from a letter to one of these signs
# behind it, so the ids of a text are those of its parts.
PARTS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[ \n,.;:!?%*#$&])|[^ \t\n\r]+")
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")  # lower case, with no other composed form
MEMO_CHARS = 64


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


# ---- planning on the histogram -------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: (pattern, multiplicity) pairs."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, times: int, room: int) -> None:
        if not times:
            return
        if not room:
            done.append((pattern, times))
            return
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((pattern, times))

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), left
            fit = room // length
            full = min(times, left // fit)
            part = left - full * fit if full < times else 0
            put((*pattern, (length, fit)), full, room - fit * length)
            if part:
                put((*pattern, (length, part)), 1, room - part * length)
            if pattern:
                put(pattern, times - full - bool(part), room)
            left -= full * fit + part
    return done + [x for room in rooms for x in open_bins[room]]


def bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the total, or pieces over half with what cannot join them."""
    total = sum(x * n for x, n in counts.items())
    least = -(-total // capacity)
    lengths = np.array(sorted(x for x, n in counts.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return 0
    numbers = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    for small in [0, *lengths[lengths * 2 <= capacity].tolist()]:
        huge = lengths > capacity - small
        large = (lengths <= capacity - small) & (lengths * 2 > capacity)
        rest = (lengths >= small) & (lengths * 2 <= capacity)
        n_large = int(numbers[large].sum())
        room = n_large * capacity - int((lengths * numbers)[large].sum())
        over = int((lengths * numbers)[rest].sum()) - room
        least = max(least, int(numbers[huge].sum()) + n_large + max(0, -(-over // capacity)))
    return least


def fillings(counts: dict[int, int], room: int, effort: int) -> tuple[list[tuple[int, Pattern]], int]:
    """Undominated fillings of `room` as (waste, pattern), least waste first, and the steps taken (at most `effort`).

    A filling is dominated, and left out, if another piece still fits, or if a piece of it (or two
    together) can give way to one longer piece that still fits. A filling without waste ends the search.
    """
    rising = sorted(x for x, n in counts.items() if n > 0 and x <= room)
    lengths = rising[::-1]
    found: list[tuple[int, Pattern]] = []
    chosen: dict[int, int] = {}
    steps = 0

    def spare(low: int, high: int) -> bool:
        """Whether a piece of a length from low to high is not in use."""
        for x in islice(rising, bisect_left(rising, low), None):
            if x > high:
                return False
            if counts[x] > chosen.get(x, 0):
                return True
        return False

    def undominated(slack: int) -> bool:
        if spare(1, slack):
            return False
        singles = list(chosen)
        pairs = [a + b for i, a in enumerate(singles) for b in singles[i:] if a != b or chosen[a] > 1]
        return not any(spare(x + 1, x + slack) for x in singles) and not any(spare(x, x + slack) for x in pairs)

    def walk(at: int, left: int) -> bool:
        nonlocal steps
        steps += 1
        if undominated(left):
            found.append((left, tuple(sorted(chosen.items(), reverse=True))))
            if not left:
                return False
        for k in range(max(at, len(rising) - bisect_right(rising, left)), len(lengths)):
            for n in range(min(counts[lengths[k]], left // lengths[k]), 0, -1):
                if steps >= effort:
                    return False
                chosen[lengths[k]] = n
                go_on = walk(k + 1, left - n * lengths[k])
                del chosen[lengths[k]]
                if not go_on:
                    return False
        return True

    walk(0, room)
    return sorted(found), steps


def _unrolled(path) -> list[tuple[Pattern, int]]:
    """The (pattern, times) of a linked list."""
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out


def complete(counts: dict[int, int], capacity: int, nodes: int = 2000, effort: int = 3000, budget: int = 300_000):
    """Bin completion by branch and bound, from the best-fit packing as incumbent.

    Around the longest piece left, undominated fillings are tried in order of waste, each as often as
    the counts allow; a branch ends when its waste exceeds what a better packing may waste. All fillings
    that were found wait on the stack, so each is returned to. Ends when the bound is met (then the
    packing is optimal), when all branches are done, after `nodes` branches or after `budget` steps in
    all, of which the search for one piece's fillings takes `effort` at most: limits on the search,
    never on the pieces.
    """
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    least = bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    if used <= least:
        return best
    visited = 0

    def opened(left: dict[int, int], bins: int, waste: int, path):
        """A branching point: its state, and the fillings around its longest piece that wait to be tried."""
        nonlocal budget, visited, used, best
        visited += 1
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        choices, steps = fillings(rest, capacity - longest, min(effort, budget))
        budget -= steps
        # Finishing a branch by best fit gives new incumbents early.
        if visited % 100 == 1:
            tail = best_fit(left, capacity)
            if bins + sum(n for _, n in tail) < used:
                used, best = bins + sum(n for _, n in tail), [*tail, *_unrolled(path)]
        return left, bins, waste, path, longest, iter(choices or [(capacity - longest, ())])

    stack = [opened({x: n for x, n in counts.items() if n > 0}, 0, 0, None)]
    while stack and visited < nodes and budget > 0 and used > least:
        left, bins, waste, path, longest, choices = stack[-1]
        spare, pattern = next(choices, (None, ()))
        if spare is None:
            stack.pop()
            continue
        need = Counter(dict(pattern))
        need[longest] += 1
        times = min(left[x] // n for x, n in need.items())
        if waste + times * spare > (used - 1) * capacity - total:
            stack.pop()  # the fillings that follow waste no less
            continue
        after = {x: n - times * need.get(x, 0) for x, n in left.items() if n > times * need.get(x, 0)}
        further = ((tuple(sorted(need.items(), reverse=True)), times), path)
        if after:
            stack.append(opened(after, bins + times, waste + times * spare, further))
        elif bins + times < used:
            used, best = bins + times, _unrolled(further)
    return best


def place_arrays(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: pieces of one length and a stretch of ranks share one entry."""
    taken: Counter = Counter()
    rows = []
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += times * n
            offset += length * n
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "first", "per", "sequence", "offset"))}


def locate(arrays: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    wide = 1 << 45  # above any rank; lengths stay far below 2**18
    at = np.searchsorted(arrays["length"] * wide + arrays["first"], length * wide + rank, side="right") - 1
    inside = rank - arrays["first"][at]
    per = arrays["per"][at]
    return arrays["sequence"][at] + inside // per, arrays["offset"][at] + inside % per * length


# ---- tokenising ------------------------------------------------------------------------------


class Ids(dict):
    """Blank-free part of a text -> its ids as little-endian unsigned 32-bit bytes; a bounded memo."""

    def __init__(self, path: str, limit: int):
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merge, self.alphabet = self.tokenizer.model.tokenize, byte_letters()

    def encode(self, part: str) -> list[int]:
        word = part.lower()
        if LETTERS.fullmatch(word):  # a single pre-token, which the vocabulary's merges take as it is
            return [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encode(part), dtype="<u4").tobytes()
        if len(part) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, PARTS.findall(text)))


def tokenised_pieces(df: DataFrame, path: str, capacity: int, memo: int) -> DataFrame:
    """One row per piece, with the task that made it and its number among that task's pieces of its length."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = worker_state(("ids", path, memo), lambda: Ids(path, memo))
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = ids.of(text) + end
                for k, at in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    rows.append((doc_id, k, at, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return df.select(F.col("doc_id").cast("long"), content().alias("text")).mapInPandas(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    )


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, memo: int = 700_000) -> DataFrame:
    """Place every document's token pieces into as few sequences of `capacity` tokens as found.

    Documents longer than `capacity` are cut; each has at least its end id, so null and empty texts
    take one token. Repeated rows are packed each; ties of length are told apart by rank; an empty
    table gives no rows; other columns are ignored. Tokens are made once; only piece rows move.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = materialize(tokenised_pieces(df, path, capacity, memo), "pieces")
    sizes = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    # A length has one row per task here, however many pieces it has.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most `capacity` rows: one per length.
    counts = {row["length"]: row["n"] for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    arrays = df.sparkSession.sparkContext.broadcast(place_arrays(complete(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = locate(arrays.value, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return (
        rows.join(starts, ["task", "length"])
        .withColumn("place", place("length", F.col("first") + F.col("number")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
    )
