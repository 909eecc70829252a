"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents. A block is a bit matrix: a column per document, a row per hash
place, so one term is looked up for all documents of a block by ANDing a few rows. A term enters the
signature once for every count in TIERS that its occurrences reach, so the rows tell an upper bound
of its occurrences. Weighted sums of these slices bound every document's score from above; documents
whose bound reaches the score known to be among the best are read and scored exactly, the others
provably cannot be among them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatable.llm.common import materialize, row_key
from lumatable.llm.mixing import with_prefix_sums

# Terms: runs of letters, digits and anything outside ASCII, A-Z lower-cased; on UTF-8 bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TIERS = (1, 2, 3, 4, 6, 9, 14, 22)  # counts at which a term enters a signature again
PROBES = 3  # rows per entry
BITS = 8  # rows per entry of the fullest document of a block
DOCUMENTS = 512  # columns of a block at most; a multiple of 8
CELLS = 1 << 25  # bits of a block at most, above eight columns
GATHER = 20_000  # texts a task holds signatures of before it lays out blocks
ENTRIES = 4_000_000  # and entries
SEEDS = 100  # documents per item that set the first threshold
TERMS = 16_384  # terms of the items handled together


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def _mixed(values: np.ndarray) -> np.ndarray:
    """A full mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _entries(hashes: np.ndarray, tier: int) -> np.ndarray:
    """Hash of the entry `term at this tier`."""
    return _mixed(hashes + np.uint64((tier + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _rows(entries: np.ndarray, width: int) -> list[np.ndarray]:
    """The rows of a signature of `width` rows that an entry sets."""
    low, high = entries & np.uint64(0xFFFFFFFF), (entries >> np.uint64(32)) | np.uint64(1)
    places = [(low + np.uint64(k) * high) & np.uint64(0xFFFFFFFF) for k in range(PROBES)]
    return [((place * np.uint64(width)) >> np.uint64(32)).astype(np.int64) for place in places]


def _signature(text: bytes) -> tuple[int, np.ndarray]:
    """(number of terms, entry hashes) of a text."""
    found = Counter(terms(text))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    counts = np.fromiter(found.values(), np.int64, len(found))
    parts = []
    for tier, least in enumerate(TIERS):
        kept = counts >= least
        if not kept.any():
            break
        parts.append(_entries(hashes[kept], tier))
    return int(counts.sum()), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _blocks(gathered: list[tuple[int, int, np.ndarray]], columns: int) -> Iterator[tuple[bytes, bytes, int, bytes]]:
    """Lay out documents as blocks; those of similar size share one, so that no signature is overfull."""
    gathered.sort(key=lambda document: len(document[2]), reverse=True)
    at = 0
    while at < len(gathered):
        width = max(64, BITS * len(gathered[at][2]))
        size = max(8, min(columns, CELLS // width // 8 * 8))
        held = gathered[at : at + size]
        at += size
        cells = np.zeros((width, -(-len(held) // 8) * 8), np.uint8)
        for column, (_, _, entries) in enumerate(held):
            for rows in _rows(entries, width):
                cells[rows, column] = 1
        keys, counts = np.array([d[0] for d in held], "<i8"), np.array([d[1] for d in held], "<i8")
        yield keys.tobytes(), counts.tobytes(), width, np.packbits(cells, axis=1).tobytes()


def build_index(df: DataFrame, columns: int = DOCUMENTS) -> DataFrame:
    """The signatures of all texts, whatever is searched for later: (keys, counts, width, bits) per block.

    `keys` are the documents' row keys, `counts` their numbers of terms, `bits` the packed matrix. One
    pass over the texts without a shuffle. Texts without terms are in no block.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, entries = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block in _blocks(gathered, columns):
                types = (pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(block, types, strict=True)], ["keys", "counts", "width", "bits"]
                )
            gathered.clear()

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                count, made = _signature(text.as_py())
                if count:
                    gathered.append((key, count, made))
                    entries += len(made)
                if len(gathered) >= GATHER or entries >= ENTRIES:
                    yield from flush()
                    entries = 0
        yield from flush()

    texts = df.where("text is not null").select(row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(lay_out, "keys binary, counts binary, width int, bits binary")


class Items:
    """A block of items: their terms, weights and the exact score of a text. A few thousand terms at most."""

    def __init__(self, wanted: list[tuple[int, bytes]], documents: int, total: int, holding: dict[bytes, int]):
        self.documents, self.total = documents, total
        known = sorted({term for _, term in wanted if term in holding})  # terms in no document add nothing
        self.place = {term: k for k, term in enumerate(known)}
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) for t in known], np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        by_item: dict[int, list[int]] = {}
        for item, term in wanted:
            if term in self.place:
                by_item.setdefault(item, []).append(self.place[term])
        self.items = sorted(by_item)
        self.terms = {item: np.array(places, np.int64) for item, places in by_item.items()}

    def scale(self, counts: np.ndarray) -> np.ndarray:
        """The denominator's part for documents with so many terms."""
        return 50 + (50 * counts * self.documents) // self.total

    def score(self, text: bytes, wanted: list[int]) -> Iterator[tuple[int, int]]:
        """(item, score) of a text for some items."""
        found = terms(text)
        scale = 50 + 50 * len(found) * self.documents // self.total
        values: dict[int, int] = {}
        for term, occurrences in Counter(found).items():
            place = self.place.get(term)
            if place is not None:
                values[place] = int(self.weight[place]) * (1_000_000_000 * occurrences // (1000 * occurrences + 20 * scale))
        for item in wanted:
            yield item, sum(values.get(place, 0) for place in self.terms[item].tolist())

    def bounds(self, counts: np.ndarray, width: int, bits: bytes) -> np.ndarray:
        """Upper bounds of all items' scores (rows) for the documents of an index block (columns).

        The values are whole numbers below 2**53, so doubles hold them exactly.
        """
        matrix = np.frombuffer(bits, np.uint8).reshape(width, -1)
        scale = self.scale(counts)
        total = np.zeros((len(self.place), len(counts)))
        reached, last = None, np.zeros(len(counts), np.int64)
        for tier in range(len(TIERS)):
            rows = _rows(_entries(self.hashes, tier), width)
            slices = matrix[rows[0]]
            for more in rows[1:]:
                slices &= matrix[more]
            reached = slices if reached is None else reached & slices  # a term reaches tiers in order
            if not reached.any():
                break
            # Most occurrences of a term that reached this tier and not the next one.
            most = np.minimum(TIERS[tier + 1] - 1, counts) if tier + 1 < len(TIERS) else counts
            value = 1_000_000_000 * most // (1000 * most + 20 * scale)
            total += np.unpackbits(reached, axis=1, count=len(counts)) * (value - last).clip(0)
            last = np.maximum(value, last)
        total *= self.weight[:, None]
        return np.stack([total[self.terms[item]].sum(axis=0) for item in self.items])


def _search_blocks(index: DataFrame, items: Items, choose, schema: str) -> DataFrame:
    """Apply `choose(bounds, keys)` to every block of the index; it yields (item, key, bound) arrays."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        chosen = choose(known)
        names = [field.split()[0] for field in schema.split(", ")]
        for batch in batches:
            for keys, counts, width, bits in zip(*(batch.column(c) for c in ("keys", "counts", "width", "bits")), strict=True):
                bounds = known.bounds(np.frombuffer(counts.as_py(), "<i8"), width.as_py(), bits.as_py())
                made = chosen.add(bounds, np.frombuffer(keys.as_py(), "<i8"))
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in made], names)
        made = chosen.end()
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in made], names)

    return index.mapInArrow(scan, schema)


class _Best:
    """Keeps the documents with the largest bounds per item over all blocks of a task."""

    def __init__(self, items: Items, number: int):
        self.items, self.number = items, number
        self.bounds = np.zeros((len(items.items), 0))
        self.keys = np.zeros((len(items.items), 0), np.int64)

    def add(self, bounds: np.ndarray, keys: np.ndarray) -> None:
        bounds = np.concatenate([self.bounds, bounds], axis=1)
        keys = np.concatenate([self.keys, np.broadcast_to(keys, (len(self.items.items), len(keys)))], axis=1)
        if bounds.shape[1] > self.number:
            top = np.argpartition(bounds, -self.number, axis=1)[:, -self.number :]
            bounds, keys = np.take_along_axis(bounds, top, axis=1), np.take_along_axis(keys, top, axis=1)
        self.bounds, self.keys = bounds, keys

    def end(self):
        item = np.repeat(np.array(self.items.items, np.int64), self.keys.shape[1])
        kept = self.bounds.reshape(-1) > 0
        return item[kept], self.keys.reshape(-1)[kept], self.bounds.reshape(-1)[kept]


class _Reaching:
    """Passes on every document whose bound reaches its item's threshold."""

    def __init__(self, items: Items, thresholds: dict[int, int]):
        self.items = np.array(items.items, np.int64)
        self.least = np.array([[max(1, thresholds.get(item, 1))] for item in items.items], np.float64)

    def add(self, bounds: np.ndarray, keys: np.ndarray):
        item, column = np.nonzero(bounds >= self.least)
        return (self.items[item], keys[column]) if len(item) else None

    def end(self) -> None:
        return None


def _scored(df: DataFrame, chosen: DataFrame, items: Items, label: str) -> DataFrame:
    """(item, doc_id, score) of the chosen (item, key) pairs, from the whole texts; scores above 0.

    The list of one document holds at most the items of a block. Written first, so that Spark knows
    its bytes and broadcasts it only if they are few.
    """
    lists = materialize(chosen.groupBy("key").agg(F.collect_set("item").alias("items")), label)
    texts = df.where("text is not null").select("doc_id", row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(items)
    id_type = dict(df.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            item, row, value = [], [], []
            for at, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("items").to_pylist(), strict=True)):
                for one, points in known.score(text.as_py(), wanted):
                    if points > 0:
                        item.append(one)
                        row.append(at)
                        value.append(points)
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(value, pa.int64())], ["item", "doc_id", "score"])

    return texts.join(lists, "key").select("doc_id", "text", "items").mapInArrow(score, f"item long, doc_id {id_type}, score long")


def _holding(df: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Exact number of rows that hold each wanted term; one pass, partial counts per task."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(shared.value.intersection(terms(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["term", "n"])

    texts = df.where("text is not null").select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(row["term"]): row["n"] for row in counted.collect()}  # at most the wanted terms


def _item_terms(items: DataFrame, limit: int) -> DataFrame:
    """(item, item_id, part, term): the items' rows numbered, dealt into parts of about `limit` terms, and their terms."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms(text.as_py()))) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    id_type = dict(items.dtypes)["item_id"]
    texts = items.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    made = texts.mapInArrow(split, f"item_id {id_type}, terms array<binary>").where("size(terms) > 0")
    sized = made.withColumn("_one", F.lit(1)).withColumn("_terms", F.size("terms"))
    placed = with_prefix_sums(sized, [F.col("item_id"), F.xxhash64("terms")], {"item": "_one", "_before": "_terms"}, "search-items")
    return placed.select("item", "item_id", F.expr(f"_before div {limit}").alias("part"), F.explode("terms").alias("term"))


def search(
    df: DataFrame, items: DataFrame, top: int = 50, seeds: int = SEEDS, limit: int = TERMS, index: DataFrame | None = None
) -> DataFrame:
    """The `top` best documents of each item: item_id, rank, doc_id, score.

    Items are handled in parts of about `limit` terms. For each part the index is read twice. First
    the `seeds` documents with the largest bounds are scored exactly; the `top`-th best score of these
    is a threshold no better document can miss. Then every document whose bound reaches the
    threshold is scored exactly. How many that are is not limited.

    Equal scores are ranked by ascending id, rows without id last. Repeated rows are documents of their
    own, repeated items (equal or null ids too) have a ranking each. Null and empty texts hold no
    term; items without terms and empty tables give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    schema = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(df.dtypes)['doc_id']}, score long"
    index = materialize(build_index(df), "search-index") if index is None else index
    lengths = F.expr("octet_length(counts) div 8")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(np.frombuffer(c.as_py(), "<i8").sum()) for batch in batches for c in batch.column("counts"))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    documents = index.agg(F.sum(lengths)).first()[0] or 0
    total = index.select("counts").mapInArrow(add_up, "n long").agg(F.sum("n")).first()[0] or 0
    wanted = materialize(_item_terms(items, limit), "search-terms")
    parts = sorted(row["part"] for row in wanted.select("part").distinct().collect()) if documents else []
    ranked = []
    for part in parts:
        rows = [(row["item"], bytes(row["term"])) for row in wanted.where(F.col("part") == part).select("item", "term").collect()]
        known = Items(rows, documents, total, _holding(df, {term for _, term in rows}))
        if not known.items:
            continue
        first = _search_blocks(index, known, lambda items: _Best(items, seeds), "item long, key long, bound double")
        by_bound = Window.partitionBy("item").orderBy(F.col("bound").desc(), "key")
        first = first.withColumn("_nth", F.row_number().over(by_bound)).where(F.col("_nth") <= seeds).select("item", "key")
        by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        nth = _scored(df, first, known, "search-seeds").withColumn("_nth", F.row_number().over(by_score)).where(F.col("_nth") == top)
        thresholds = {row["item"]: row["score"] for row in nth.collect()}  # at most one per item
        reaching = _search_blocks(index, known, lambda items: _Reaching(items, thresholds), "item long, key long")
        scored = _scored(df, reaching, known, "search-candidates")
        best = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
        ranked.append(materialize(best, "search-best"))
    if not ranked:
        return spark.createDataFrame([], schema)
    best = ranked[0]
    for more in ranked[1:]:
        best = best.unionByName(more)
    named = wanted.select("item", "item_id").distinct()
    return best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
item_terms AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
counts AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM found WHERE len(t) > 0),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM found)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), counts),
scored AS (
  SELECT item, item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * docs) // total)))) AS BIGINT) AS score
  FROM item_terms JOIN held USING (term) JOIN weights USING (term) JOIN found USING (r), counts
  GROUP BY item, item_id, r),
ranked AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
  FROM scored JOIN found USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
