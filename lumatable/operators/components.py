"""Eight-connected components of foreground pixels, as runs of neighbouring pixels.

A run is a stretch of foreground in one line of an image. Lines are put together as arrays, partly
before any exchange, so no pixel is a row of its own. Runs are joined by union-find inside a strip of
lines, which fits one task whatever the image size. Only the figures of strip components and the runs
at strip edges leave a strip: components that meet there are contracted in rounds, each cut with a
reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatable.session import cut_lineage

TILE = 256  # lines of a strip
_SHIFT = 1 << 31


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of consecutive places, in order."""
    x = np.unique(x)
    cut = np.flatnonzero(np.diff(x) > 1)
    return x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]


def touching(above: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of runs in neighbouring lines that touch, corners included."""
    low = np.searchsorted(above[1], below[0] - 1)
    high = np.searchsorted(above[0], below[1] + 1, side="right")
    count = np.maximum(high - low, 0)
    second = np.repeat(np.arange(len(below[0])), count)
    return np.arange(len(second)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count), second


def union(n: int, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Smallest member of the set of each of n elements that the given pairs join."""
    parent = np.arange(n)
    while True:
        a, b = parent[here], parent[there]
        if np.array_equal(a, b):
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]


def _label(y: np.ndarray, lines: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(y, first, last, root) of the runs of one strip; y ascends, one array of places per line."""
    made = [runs_of(np.asarray(x)) for x in lines]
    counts = np.array([len(first) for first, _ in made])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    here, there = [], []
    for k in range(1, len(made)):
        if y[k] == y[k - 1] + 1:
            a, b = touching(made[k - 1], made[k])
            here.append(a + offsets[k - 1])
            there.append(b + offsets[k])
    none = np.zeros(0, np.int64)
    roots = union(int(offsets[-1]), np.concatenate(here or [none]), np.concatenate(there or [none]))
    first, last = (np.concatenate([runs[side] for runs in made]) for side in (0, 1))
    return np.repeat(y, counts), first, last, roots


_RUNS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("first", "last", "node")])
_STRIP = T.StructType(
    [T.StructField("node", T.ArrayType(T.LongType())), T.StructField("size", T.ArrayType(T.LongType()))]
    + [T.StructField(f"{edge}_{n}", T.ArrayType(T.LongType())) for edge in ("top", "bottom") for n in ("first", "last", "node")]
)


def strip_components(foreground: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, strip, node[], size[], top, bottom): the components inside each strip of `tile` lines.

    A node is named by its first pixel, y * 2**31 + x. top and bottom hold the runs of the strip's first
    and last line with their nodes.
    """
    lines = foreground.groupBy("image_id", F.col("y").cast("bigint").alias("y")).agg(F.collect_list(F.col("x").cast("bigint")).alias("x"))
    strip = F.floor(F.col("y") / tile).cast("bigint")
    strips = lines.groupBy("image_id", strip.alias("strip")).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("lines"))

    @F.pandas_udf(_STRIP)
    def label(strip: pd.Series, y: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = []
        for number, lines_y, lines_x in zip(strip, y, x, strict=True):
            at, first, last, roots = _label(np.asarray(lines_y), list(lines_x))
            names = at[roots] * _SHIFT + first[roots]
            found, inverse = np.unique(roots, return_inverse=True)
            sizes = np.bincount(inverse, weights=(last - first + 1)).astype(np.int64)
            row = [at[found] * _SHIFT + first[found], sizes]
            for edge in (number * tile, number * tile + tile - 1):
                here = at == edge
                row += [first[here], last[here], names[here]]
            out.append(row)
        return pd.DataFrame(out, columns=_STRIP.names)

    labelled = strips.withColumn("_s", label("strip", F.col("lines.y"), F.col("lines.x")))

    def edge(name: str) -> Column:
        return F.struct(*[F.col(f"_s.{name}_{part}").alias(part) for part in _RUNS.names]).alias(name)

    return labelled.select("image_id", "strip", "_s.node", "_s.size", edge("top"), edge("bottom"))


def border_links(strips: DataFrame) -> DataFrame:
    """Distinct pairs of nodes that touch across a strip border, in both directions.

    The runs at a border of two strips are two sorted arrays, matched by a merge inside one row.
    """
    kept = F.size("runs.first") > 0
    below = strips.select("image_id", "strip", F.col("top").alias("runs")).where(kept)
    above = strips.select("image_id", (F.col("strip") + 1).alias("strip"), F.col("bottom").alias("over")).where(F.size("over.first") > 0)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def meet(over: pd.DataFrame, runs: pd.DataFrame) -> pd.Series:
        out = []
        for row in zip(*(frame[part] for frame in (over, runs) for part in _RUNS.names), strict=True):
            a_first, a_last, a_node, b_first, b_last, b_node = (np.asarray(v) for v in row)
            a, b = touching((a_first, a_last), (b_first, b_last))
            out.append(np.unique(np.stack([a_node[a], b_node[b]], axis=1), axis=0).tolist() if len(a) else [])
        return pd.Series(out)

    met = above.join(below, ["image_id", "strip"]).select("image_id", F.explode(meet("over", "runs")).alias("_p"))
    links = met.select("image_id", F.col("_p")[0].alias("a"), F.col("_p")[1].alias("b"))
    return links.unionByName(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _tops(parents: DataFrame) -> DataFrame:
    """(image_id, node, parent) with every parent followed to its end. Each round doubles the steps taken."""
    parents = cut_lineage(parents)
    while True:
        further = parents.select("image_id", F.col("node").alias("parent"), F.col("parent").alias("_next"))
        moved = cut_lineage(
            parents.join(further, ["image_id", "parent"]).select(
                "image_id", "node", F.col("_next").alias("parent"), (F.col("_next") != F.col("parent")).alias("_moved")
            )
        )
        parents = moved.select("image_id", "node", "parent")
        if moved.where("_moved").isEmpty():
            return parents


def merge_nodes(links: DataFrame) -> DataFrame:
    """(image_id, node, component) for nodes that touch another strip; the rest are their own component.

    A round ties every component to the least of its neighbours, follows these ties to their ends and
    draws the links between what is left; only components below all their neighbours stay apart, so
    rounds are few even for a component that winds through many strips.
    """
    links = cut_lineage(links)
    labels = cut_lineage(links.select("image_id", F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    while not links.isEmpty():
        least = links.groupBy("image_id", F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        tops = _tops(least.select("image_id", "node", F.least("node", "_least").alias("parent")))
        ends = {side: tops.select("image_id", F.col("node").alias(side), F.col("parent").alias(f"_{side}")) for side in ("a", "b")}
        drawn = links.join(ends["a"], ["image_id", "a"]).join(ends["b"], ["image_id", "b"]).where("_a != _b")
        links = cut_lineage(drawn.select("image_id", F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        steps = tops.select("image_id", F.col("node").alias("component"), "parent")
        labels = cut_lineage(
            labels.join(steps, ["image_id", "component"], "left").select(
                "image_id", "node", F.coalesce("parent", "component").alias("component")
            )
        )
    return labels


def components(foreground: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, component, size) of a table of foreground pixels (image_id, y, x); repeated pixels count once.

    What is checkpointed is one row per strip, with its components and edge runs; no pixel is. Without
    links over strip borders the merge ends at once.
    """
    strips = cut_lineage(strip_components(foreground, tile))
    merged = merge_nodes(border_links(strips))
    sizes = strips.select("image_id", F.explode(F.arrays_zip("node", "size")).alias("_n")).select("image_id", "_n.node", "_n.size")
    return (
        sizes.join(merged, ["image_id", "node"], "left")
        .groupBy("image_id", F.coalesce("component", "node").alias("component"))
        .agg(F.sum("size").alias("size"))
    )


def largest_share(images: DataFrame, parts: DataFrame) -> DataFrame:
    """Largest component over all foreground, zero for images without foreground."""
    per_image = parts.groupBy("image_id").agg(
        (F.max("size") / F.sum("size")).alias("_share"), F.count(F.lit(1)).alias("_n")
    )
    return images.select("image_id").join(per_image, "image_id", "left").select(
        "image_id", F.coalesce("_share", F.lit(0.0)).alias("largest_share"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_components"),
    )
