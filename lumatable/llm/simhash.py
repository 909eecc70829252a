"""Near-duplicates by SimHash fingerprints, searched through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatable.llm import golay
from lumatable.llm.common import content, materialize, row_key
from lumatable.llm.components import components
from lumatable.llm.shingles import shingle_hashes

SHINGLE = 3
SEED = 42
DISTANCE = 3
WIDTHS = (22, 21, 21)  # segments of the 64 bits, each within a 23-bit word of the code
ORDERED = tuple(permutations(range(3), 2))  # an equal segment and one with at most one differing bit
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over the shingles of white-space words, A-Z lower-cased."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def segments(prints: np.ndarray) -> list[np.ndarray]:
    """The segments of unsigned fingerprints as 23-bit words."""
    out, at = [], 0
    for width in WIDTHS:
        out.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def _near(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per segment: its words, their indices, the nearby indices in order, and which of these are no repeats."""
    parts = segments(prints)
    near = [np.sort(golay.nearby(s, w), axis=1) for s, w in zip(parts, WIDTHS, strict=True)]
    fresh = [np.concatenate([np.ones((len(n), 1), bool), n[:, 1:] != n[:, :-1]], axis=1) for n in near]
    return parts, [golay.decode(s) for s in parts], near, fresh


def probe_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys a fingerprint is looked up by; `stored_keys` says why."""
    parts, index, near, fresh = _near(prints)
    row, c = np.nonzero(fresh[2])
    rows, keys = [row], [index[0][row] << 24 | index[1][row] << 12 | near[2][row, c]]
    for tag, (i, j) in enumerate(ORDERED, start=1):
        rows.append(np.arange(len(prints)))
        keys.append(tag << 36 | parts[i] << 12 | index[j])
    return np.concatenate(rows), np.concatenate(keys)


def stored_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys under which a fingerprint must be found by one at most DISTANCE bits away.

    At most three differing bits over three segments lie in one of two ways. No segment has more than
    one: then each segment's index is among the other's nearby ones, and the key is all three indices
    (36 bits); the nearby ones of two segments are stored, those of the third are looked up. Or one
    segment has two or three: then of the others one is equal and one has at most one, and the key is
    the equal segment and the index of the other (33 or 34 bits), for each choice of the two.
    """
    parts, index, near, fresh = _near(prints)
    row, a, b = np.nonzero(fresh[0][:, :, None] & fresh[1][:, None, :])
    rows, keys = [row], [near[0][row, a] << 24 | near[1][row, b] << 12 | index[2][row]]
    for tag, (i, j) in enumerate(ORDERED, start=1):
        row, b = np.nonzero(fresh[j])
        rows.append(row)
        keys.append(tag << 36 | parts[i][row] << 12 | near[j][row, b])
    return np.concatenate(rows), np.concatenate(keys)


def _unsigned(prints: pd.Series) -> np.ndarray:
    return prints.to_numpy(dtype=np.int64).view(np.uint64)


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints at most `distance` (3 or fewer) bits apart.

    Each fingerprint is stored under about 60 keys of 33 to 36 bits and looked up by about 11;
    pairs are verified inside the join, so only links leave it.
    """
    if distance > DISTANCE:
        raise ValueError(f"the keys find up to {DISTANCE} differing bits")

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                prints = batch["fp"].iloc[at : at + 2000]
                row, key = stored_keys(_unsigned(prints))
                yield pd.DataFrame({"key": key, "a": prints.to_numpy()[row]})

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, key = probe_keys(_unsigned(batch["fp"]))
            yield pd.DataFrame({"key": key, "b": batch["fp"].to_numpy()[row]})

    kept = nodes.select("fp").mapInPandas(stored, "key long, a long")
    asked = nodes.select("fp").mapInPandas(probes, "key long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return kept.alias("s").join(asked.alias("p"), (F.col("s.key") == F.col("p.key")) & near).select("a", "b").distinct()


def fingerprints(df: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each whole text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        prints = np.array([fingerprint(text, shingle, seed) for text in texts], dtype=np.uint64)
        return pd.Series(prints.view(np.int64))

    return df.select(F.col("doc_id").cast("long"), row_key().alias("key"), of(content()).alias("fp"))


def near_duplicates(df: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Fingerprint and component of each document; components join fingerprints `distance` bits apart.

    Documents with equal fingerprints are one node, so a group of copies costs one search however
    large it is. Null and empty texts have fingerprint zero and link like any other; repeated rows give
    a row each; ids that are null never name a component; an empty table gives no rows; other
    columns are ignored.
    """
    return _classes(df, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(df: DataFrame, distance: int) -> DataFrame:
    prints = materialize(fingerprints(df), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes, distance), "a", "b")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp")


def keep_one(df: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`df` with one document of each group of near-duplicates: the one with the smallest id.

    Rows with equal id and text count as one; rows without id represent nobody and stay. All
    columns stay; the texts move once, to meet the ids that are kept.
    """
    kept = (
        _classes(df, distance)
        .where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
        .select(F.col("doc_id").alias("_llm_id"), F.col("key").alias("_llm_key"))
        .distinct()
    )
    rows = df.withColumn("_llm_row", row_key())
    same = rows["doc_id"].cast("long").eqNullSafe(kept["_llm_id"]) & (rows["_llm_row"] == kept["_llm_key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_llm_row"]).select(*df.columns)
