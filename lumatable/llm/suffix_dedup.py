"""Removal of repeated strings of bytes, found by suffix arrays over anchored segments.

Windows of 100 bytes are cut into segments that share a content-defined anchor, so equal windows lie in
segments of equal anchors, wherever they are. Segments whose anchor occurs once hold no repeat.
Equal segments are one class and need a single string. Classes that share an anchor but differ meet in one
partition, where the difference-cover algorithm sorts their suffixes and neighbours with an equal prefix of
100 bytes are the repeats. An anchor with very many classes is salted, and what is left of it is
compared once more by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.llm.common import content, materialize, row_key
from lumatable.llm.suffixes import Anchors, equal_prefixes, suffix_array

LENGTH = 100
FILTER_BITS = 26  # of the fixed-size filter of repeated anchors: 8 MB, whatever the table's size
BLOCK_BITS = 13  # 64-bit words of the filter that one row brings to the driver
MAX_CLASSES = 8192  # strings of one anchor that are sorted together; more are salted
CHUNK = 1 << 19  # bytes of text in one suffix array, but for the last anchor's
LAST = (1 << 63) - 1  # documents without id come last


def _documents(df: DataFrame) -> DataFrame:
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return df.select(doc_id.alias("ord"), row_key().alias("key"), content().alias("text"))


def _free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs, which it does when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def _repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Anchors(length)
        for batch in batches:
            for hashes, *_ in cutter.batches([text.encode() for text in batch["text"]]):
                yield pd.DataFrame({"g": hashes})

    return docs.select("text").mapInPandas(anchors, "g long").groupBy("g").count().where("count > 1").select("g")


def _filter(repeated: DataFrame) -> np.ndarray:
    """Bits of a fixed-size filter that lets all repeated anchors through; it may let others through too."""
    mask = (1 << FILTER_BITS) - 1
    places = F.array(F.shiftrightunsigned("g", 64 - FILTER_BITS), F.shiftrightunsigned("g", 12).bitwiseAND(mask))
    bits = repeated.select(F.explode(places).alias("b"))
    words = bits.groupBy(F.shiftrightunsigned("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    blocks = words.groupBy(F.shiftrightunsigned("w", BLOCK_BITS).alias("block")).agg(F.collect_list(F.struct("w", "bits")).alias("words"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for block, found in zip(batch["block"], batch["words"], strict=True):
                part = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                part[[x["w"] & (1 << BLOCK_BITS) - 1 for x in found]] = [x["bits"] for x in found]
                made.append((block, part.tobytes()))
            yield pd.DataFrame(made, columns=["block", "data"])

    out = np.zeros((1 << (FILTER_BITS - 6 - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.int64)
    for row in blocks.mapInPandas(pack, "block long, data binary").toLocalIterator():  # 8 MB at most
        out[row["block"]] = np.frombuffer(row["data"], dtype=np.int64)
    return out.reshape(-1).view(np.uint64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    g = hashes.view(np.uint64)
    ok = np.ones(len(g), dtype=bool)
    for place in (g >> np.uint64(64 - FILTER_BITS), g >> np.uint64(12) & np.uint64((1 << FILTER_BITS) - 1)):
        ok &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _segments(docs: DataFrame, bits: np.ndarray, length: int) -> DataFrame:
    """Segments whose anchor may be repeated: anchor hash, hash of the segment's bytes, place."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Anchors(length)
        for batch in batches:
            ords, keys = batch["ord"].to_numpy(), batch["key"].to_numpy()
            for hashes, number, lo, hi, data, at in cutter.batches([text.encode() for text in batch["text"]]):
                ok = _passes(shared.value, hashes)
                hashes, number, lo, hi, at = hashes[ok], number[ok], lo[ok], hi[ok], at[ok]
                ends = at + (hi - lo) + length
                whole = [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                s = np.array(whole, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"g": hashes, "s": s, "ord": ords[number], "key": keys[number], "lo": lo, "hi": hi})

    return docs.mapInPandas(cut, "g long, s long, ord long, key long, lo long, hi long")


def _strings(docs: DataFrame, classes: DataFrame, length: int, max_classes: int) -> DataFrame:
    """The bytes of one segment of each class that shares its anchor with another class."""
    sizes = classes.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    salts = F.ceil(F.col("m") / max_classes)
    wanted = classes.join(sizes, "g").select(
        "g",
        F.when(salts > 1, 1 + F.pmod(F.xxhash64("first.ord", "first.key", "first.lo"), salts)).otherwise(0).cast("long").alias("salt"),
        "first.ord", "first.key", "first.lo", "first.hi",
    )
    by_doc = wanted.groupBy("ord", "key").agg(F.collect_list(F.struct("g", "salt", "lo", "hi")).alias("cuts"))
    texts = docs.dropDuplicates(["ord", "key"]).join(by_doc, ["ord", "key"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, key, text, cuts in zip(batch["ord"], batch["key"], batch["text"], batch["cuts"], strict=True):
                data = text.encode()
                rows += [(c["g"], c["salt"], doc, key, c["lo"], data[c["lo"] : c["hi"] + length]) for c in cuts]
            yield pd.DataFrame(rows, columns=["g", "salt", "ord", "key", "lo", "data"])

    return texts.mapInPandas(cut, "g long, salt long, ord long, key long, lo long, data binary")


def repeated_windows(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every window of the strings; windows are of one class if their bytes are equal."""
    text = np.concatenate([np.frombuffer(s + b"\0", dtype=np.uint8) for s in strings]).astype(np.int64) + 1
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    text[starts + sizes - 1] = 1  # less than any byte, as in all bytes plus 2 below
    letters = text + 1
    letters[starts + sizes - 1] = 1
    order = suffix_array(letters)
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(text)) - starts[owner]
    inside = offset + length <= sizes[owner] - 1
    order = order[inside[order]]  # windows with an equal prefix stay neighbours
    same = equal_prefixes(text - 1, order, length)
    return owner[order], offset[order], np.cumsum(~same) - 1


def _sorted_suffixes(strings: DataFrame, length: int) -> DataFrame:
    """Windows that occur earlier, as runs (h1, h2 null); of salted anchors also the windows that are first so far."""
    schema = "ord long, key long, lo long, hi long, h1 long, h2 long"

    def compare(rows: list[tuple]) -> pd.DataFrame:
        ords = np.array([r[2] for r in rows], dtype=np.int64)
        keys = np.array([r[3] for r in rows], dtype=np.int64)
        los = np.array([r[4] for r in rows], dtype=np.int64)
        string, offset, kind = repeated_windows([bytes(r[5]) for r in rows], length)
        doc = np.unique(np.stack([ords, keys], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        at = los[string] + offset
        by = np.lexsort((at, doc[string], kind))
        # The same place may be in two strings of one document; it is no repeat of itself.
        head = np.concatenate([[True], kind[by][1:] != kind[by][:-1]]) if len(by) else np.zeros(0, dtype=bool)
        first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by
        later = (doc[string[by]] != doc[string[first]]) | (at[by] != at[first])
        found = by[later]
        found = found[np.lexsort((offset[found], string[found]))]
        s, o = string[found], offset[found]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)]) if len(s) else np.zeros(0, dtype=bool)
        a = np.flatnonzero(new)
        z = np.concatenate([a[1:], [len(s)]]) - 1 if len(a) else a
        runs = pd.DataFrame({"ord": ords[s[a]], "key": keys[s[a]], "lo": los[s[a]] + o[a], "hi": los[s[a]] + o[z]})
        runs["h1"] = runs["h2"] = pd.Series([None] * len(runs), dtype="Int64")
        left = [k for k in by[~later].tolist() if rows[string[k]][1]]
        if left:
            windows = [bytes(rows[string[k]][5])[offset[k] : offset[k] + length] for k in left]
            h1, h2 = (np.array([xxhash.xxh64_intdigest(w, seed) for w in windows], dtype=np.uint64).view(np.int64) for seed in (1, 2))
            s = string[left]
            more = pd.DataFrame({"ord": ords[s], "key": keys[s], "lo": at[left], "hi": at[left], "h1": h1, "h2": h2})
            more = more.astype({"h1": "Int64", "h2": "Int64"})
            runs = pd.concat([runs, more]) if len(runs) else more
        return runs

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []  # whole groups
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if group and row[:2] != group[0][:2]:
                    done += group
                    group = []
                    if size >= CHUNK:
                        yield compare(done)
                        done, size = [], 0
                group.append(row)
                size += len(row[5])
        if done or group:
            yield compare(done + group)

    ordered = strings.repartition("g", "salt").sortWithinPartitions("g", "salt")
    return ordered.mapInPandas(walk, schema)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(ord, key, lo, hi): runs of window starts in a document whose bytes also start earlier."""
    spark = docs.sparkSession
    repeated = materialize(_repeated_anchors(docs, length), "anchors")
    _free_shuffles(spark)
    segments = materialize(_segments(docs, _filter(repeated), length), "segments")
    classes = segments.groupBy("g", "s").agg(F.min(F.struct("ord", "key", "lo", "hi")).alias("first"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    _free_shuffles(spark)
    firsts = classes.where("n > 1").select("g", "s", "first")
    is_first = (F.col("ord") == F.col("first.ord")) & (F.col("key") == F.col("first.key")) & (F.col("lo") == F.col("first.lo"))
    copies = segments.join(firsts, ["g", "s"]).where(~is_first).select("ord", "key", "lo", "hi")
    strings = materialize(_strings(docs, classes, length, max_classes), "strings")
    _free_shuffles(spark)
    compared = materialize(_sorted_suffixes(strings, length), "compared")
    left = compared.where("h1 is not null")
    least = left.groupBy("h1", "h2").agg(F.min(F.struct("ord", "key", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = left.join(least, ["h1", "h2"]).where(~is_first).select("ord", "key", "lo", "hi")
    ranges = copies.union(compared.where("h1 is null").select("ord", "key", "lo", "hi")).union(late)
    per_doc = ranges.groupBy("ord", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    per_doc = materialize(per_doc, "ranges")
    _free_shuffles(spark)
    return per_doc


def kept_parts(data: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[list[bytes], int, int]:
    """What is left of `data` without the windows starting in `ranges`; bytes and runs removed."""
    parts, at, removed, spans = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(ranges):
        if lo > end:  # a new run: it does not touch the one before
            if end >= 0:
                at = end
            parts.append(data[at:lo])
            spans += 1
            removed += hi + length - lo
            end = hi + length
        elif hi + length > end:
            removed += hi + length - end
            end = hi + length
    parts.append(data[max(end, 0) :])
    return parts, removed, spans


def remove_repeats(df: DataFrame, length: int = LENGTH, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Bytes of each text that lie in no string of `length` bytes that also starts earlier.

    Earlier means a smaller id, or the same document further ahead; documents without id come last,
    documents with equal ids in the order of a hash of their texts, and rows that repeat an id and
    its text are one document with a result each. Null is an empty text; texts shorter than `length` are kept whole;
    an empty table gives no rows; other columns are ignored.
    """
    docs = _documents(df)
    ranges = repeated_ranges(docs, length, max_classes)
    rows = docs.join(ranges, ["ord", "key"], "left").select("ord", "text", "ranges")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch["ord"], batch["text"], batch["ranges"], strict=True):
                data = text.encode()
                pairs = [] if found is None else [(r["lo"], r["hi"]) for r in found]
                parts, removed, spans = kept_parts(data, pairs, length)
                out.append((doc, len(data), removed, spans, hashlib.sha256(b"".join(parts)).hexdigest()))
            yield pd.DataFrame(out, columns=["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cleaned = rows.mapInPandas(cut, "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cleaned.select(F.when(F.col("ord") != LAST, F.col("ord")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = """
WITH hexed AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM hexed),
windows AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS w FROM starts),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows),
late AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM ranked WHERE r > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM late GROUP BY doc_id, run),
marked AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM marked),
spans AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM grouped GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM spans),
cut AS (
  SELECT g.doc_id, sum(z - a) AS removed, count(*) AS n, max(z) AS last,
    string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) AS kept
  FROM gaps g JOIN hexed x ON x.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT x.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM hexed x LEFT JOIN cut c ON c.doc_id = x.doc_id
"""
