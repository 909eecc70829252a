"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the range is kept.

Shingles are runs of bytes, so that a text of a few words has many of them: a text of s different
shingles has no hash in its sketch with probability (1 - 1/SCALE) ** s, which is 5 % for a piece of six
words (some 22 shingles), and nothing is put in its place. The share of a smaller text's k kept hashes
estimates its containment c with a standard error of sqrt(c * (1 - c) / k), and exactly where c is 0 or 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatable.llm.common import content, row_key, shuffle_partitions

SHINGLE = 12  # bytes of the text, A-Z lower-cased and white space as single blanks
SCALE = 8  # one hash in so many is kept
PIECE = 1 << 20  # shingles hashed at once
BASE = 0x9E3779B97F4A7C15  # base of the rolling hash, odd


def _mixed(values: np.ndarray) -> np.ndarray:
    """A full mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of `size` values, put together from runs of powers of two."""
    total, held, width, at = None, data, 1, 0  # held: hashes of runs of `width`
    while width <= size:
        if size & width:
            # The runs counted so far stand to the right of this one.
            if total is None:
                total, at = held, width
            else:
                n = len(total) - width
                total = held[:n] * np.uint64(pow(BASE, at, 1 << 64)) + total[width : width + n]
                at += width
        if 2 * width <= size:
            held = held[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + held[width:]
        width *= 2
    return total


def sketch(text: str, scale: int = SCALE, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes below 2**64 / scale, whatever their number.

    A text shorter than a shingle is one shingle; a text without anything but white space has none.
    """
    line = b" ".join(text.encode().lower().split())  # on bytes, both touch ASCII only
    if not line:
        return np.empty(0, np.uint64)
    size, kept = min(shingle, len(line)), []
    for at in range(0, len(line) - size + 1, PIECE):
        data = np.frombuffer(line[at : at + PIECE + size - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        hashes = _mixed(_rolled(data, size) + np.uint64(size))
        kept.append(hashes[hashes < np.uint64((1 << 64) // scale)])
    return np.unique(np.concatenate(kept))


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the texts together: thresholds are fixed, so the union is exact."""
    return np.unique(np.concatenate(sketches))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the larger one holds.

    An empty sketch tells nothing: two of them are equal fingerprints and count as 1, one as 0.
    """
    least = min(len(a), len(b))
    if not least:
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _later(key: Column) -> Column:
    """Turns the order of keys round."""
    return F.bitwise_not(key)


def _in_order(df: DataFrame) -> DataFrame:
    """Rows by buckets of descending id, each bucket followed by the first row of the next one.

    Only ids and keys are looked at to find buckets and their first rows (one row per bucket); then the
    texts move once. Rows without id come last, in order of their keys: hashes, so equal ranges of
    them make equal buckets.
    """
    partitions = shuffle_partitions(df.sparkSession)
    buckets = 4 * partitions
    ids = df.select(F.col("doc_id").cast("double").alias("at"), "doc_id")
    cuts = ids.where("doc_id is not null").stat.approxQuantile("at", [k / buckets for k in range(1, buckets)], 0.1 / buckets)
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep")

    def placed(rows: DataFrame) -> DataFrame:
        # Bucket 0 has the largest ids; rows without id come last.
        at = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))
        share = (F.col("_key").cast("double") + float(1 << 63)) / float(1 << 64)
        unnamed = F.lit(len(splits)) + F.least(F.floor(share * buckets), F.lit(buckets - 1))
        bucket = F.when(F.col("doc_id").isNull(), unnamed).otherwise(len(splits) - F.col("_bucket"))
        return bucketizer.transform(rows.withColumn("_at", at)).withColumn("_bucket", bucket.cast("int")).drop("_at")

    keyed = df.select(F.col("doc_id").cast("long"), content().alias("text"), row_key().alias("_key"))
    most = F.max(F.struct("doc_id", _later(F.col("_key")).alias("late"))).alias("most")
    first = {  # at most one row per bucket
        row["_bucket"]: (row["most"]["doc_id"], ~row["most"]["late"])
        for row in placed(keyed.select("doc_id", "_key")).groupBy("_bucket").agg(most).collect()
    }
    order = sorted(first)
    heads = [(bucket, *first[bucket], order[k - 1]) for k, bucket in enumerate(order)]  # the very first follows the last
    head = df.sparkSession.createDataFrame(heads, "_head int, _id long, _first long, _before int")
    rows = placed(keyed).join(
        F.broadcast(head),
        (F.col("_bucket") == F.col("_head")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_first")),
        "left",
    )
    copies = F.expr(
        "if(_head is null, array(struct(_bucket as b, false as extra)),"
        " array(struct(_bucket as b, false as extra), struct(_before as b, true as extra)))"
    )
    return (
        rows.select("doc_id", "text", "_key", F.inline(copies))
        .repartition(partitions, "b")
        .sortWithinPartitions("b", "extra", F.col("doc_id").desc_nulls_last(), "_key")
        .select("doc_id", "text", "b", "extra")
    )


def compare_edits(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Sketches of each text and of its edited form, and their likeness to it and to the next text.

    The next document has the next smaller id (rows without id come last, equal ids in the order
    of a hash of the text); after the last comes the first. Likeness is the containment of the
    smaller text. Null is empty; empty texts have an empty sketch and are alike among themselves only;
    repeated rows follow each other; an empty table gives no rows; other columns are ignored.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (bucket, id, text, sketch) of the row that waits for the next one
        for batch in batches:
            out = []
            ids = batch["doc_id"].astype("Int64")
            for bucket, extra, doc_id, text in zip(batch["b"], batch["extra"], ids, batch["text"], strict=True):
                if extra and (held is None or held[0] != bucket):
                    continue  # a further row of the id that starts the next bucket
                own = sketch(text, scale)
                if held is not None:
                    _, last_id, last_text, last = held
                    changed = edited(last_text, text)
                    other = sketch(changed, scale)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    near = containment(last, other), containment(last, own)
                    out.append((last_id, len(last_text), digest, written(last), written(other), *near))
                held = None if extra else (bucket, doc_id, text, own)
            names = [column.split()[0] for column in schema.split(",")]
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return _in_order(df).mapInPandas(compare, schema)
