"""Ordered operators that hold when one key owns a third of all rows.

A plain window sends every row of a key to one task. Here rows are cut into blocks of
about equal size by splitters of (key, position), taken from a bounded sample: a key
with many rows has many blocks however its positions are spread, small keys share
one. Rows are windowed per key and block, totals (small, partially aggregated) are
scanned per key, and the carry is joined back. There are MOST_BLOCKS blocks at most,
so a key has no more totals than that. Positions must be whole numbers, unique within
a key; keys must not be null.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.session import cut_lineage

BLOCK_ROWS = 1 << 16  # rows of a block, more where MOST_BLOCKS would not do
MOST_BLOCKS = 4096
SAMPLE = 50  # sampled rows per block
FAN = 64  # totals composed in one row
SALTS = 32


def splitters(df: DataFrame, keys: list[str], pos: str, block: int | None = None) -> list[tuple[int, int]]:
    """(hash of the key, position) where blocks begin: quantiles of a sample of SAMPLE rows per block.

    The sample only decides where blocks are cut; results are the same with any splitters.
    """
    placed = df.select(F.xxhash64(*keys).alias("h"), F.col(pos).cast("bigint").alias("p"))
    total = placed.count()
    blocks = min(MOST_BLOCKS, -(-total // (block or BLOCK_ROWS)))
    if blocks < 2:
        return []
    share = SAMPLE * blocks / total
    rows = sorted(map(tuple, (placed if share >= 1 else placed.sample(fraction=share, seed=3)).collect()))
    return sorted({rows[k * len(rows) // blocks] for k in range(1, blocks)}) if rows else []


def block_of(keys: list[str], pos: str, cuts: list[tuple[int, int]]) -> Column:
    """Number of the block of a row; blocks of a key ascend with the position."""
    if not cuts:
        return F.lit(0)
    hashes, places = (np.array(side, np.int64) for side in zip(*cuts, strict=True))

    @F.pandas_udf("int")
    def find(h: pd.Series, p: pd.Series) -> pd.Series:
        h, p = h.to_numpy(), p.to_numpy()
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        found = low.copy()
        for key in np.unique(h[low < high]):  # keys that a splitter lies in
            mine, first, last = h == key, np.searchsorted(hashes, key, "left"), np.searchsorted(hashes, key, "right")
            found[mine] = first + np.searchsorted(places[first:last], p[mine], "right")
        return pd.Series(found)

    return find(F.xxhash64(*keys), F.col(pos).cast("bigint"))


def _last_known(value: Column, pos: Column) -> Column:
    """Value at the greatest position where it is known."""
    return F.max_by(value, F.when(value.isNotNull(), pos))


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    block: int | None = None,
) -> DataFrame:
    """Running max, sum or last known value per key in position order.

    specs maps an output column to ("max" | "sum" | "last", expression). With
    inclusive=False the current row is left out.
    """
    rows = df.withColumn("_block", block_of(keys, pos, splitters(df, keys, pos, block)))
    for name, (_, expr) in specs.items():
        rows = rows.withColumn(f"_in_{name}", expr)

    def whole(kind: str, name: str) -> Column:
        value = F.col(f"_in_{name}")
        if kind == "last":
            return _last_known(value, F.col(pos))
        return F.max(value) if kind == "max" else F.sum(value)

    def over(kind: str, value: Column, window) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return (F.max(value) if kind == "max" else F.sum(value)).over(window)

    def merged(kind: str, carry: Column, inner: Column) -> Column:
        if kind == "last":
            return F.coalesce(inner, carry)
        if kind == "max":
            return F.greatest(carry, inner)
        return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(carry + inner)

    totals = rows.groupBy(*keys, "_block").agg(
        *[whole(kind, name).alias(f"_carry_{name}") for name, (kind, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_block",
        *[over(kind, F.col(f"_carry_{name}"), before).alias(f"_carry_{name}") for name, (kind, _) in specs.items()],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(pos)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(carry, [*keys, "_block"], "left")
    results = {
        name: merged(kind, F.col(f"_carry_{name}"), over(kind, F.col(f"_in_{name}"), inside))
        for name, (kind, _) in specs.items()
    }
    return joined.withColumns(results).select(*df.columns, *specs)


def numbered(
    df: DataFrame, keys: list[str], pos: str, name: str = "rank", start: int = 1, block: int | None = None
) -> DataFrame:
    """Exact row number per key in position order."""
    counted = running(df, keys, pos, {name: ("sum", F.lit(1).cast("bigint"))}, block=block)
    return counted if start == 1 else counted.withColumn(name, F.col(name) + (start - 1))


def top_rows(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str], salts: int = SALTS
) -> DataFrame:
    """First n rows per key. Each map task keeps n per key and salt, a second cut keeps n per key."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_salt", salt)
        .withColumn("_nth", F.row_number().over(salted))
        .where(F.col("_nth") <= n)
        .drop("_salt", "_nth")
    )
    return cut.withColumn("_nth", F.row_number().over(final)).where(F.col("_nth") <= n).drop("_nth")


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], salts: int = SALTS) -> DataFrame:
    """Rows with the facts of their key (one row per key); a key with most rows is dealt to `salts` tasks.

    Where Spark finds the facts small it broadcasts them and neither side is shuffled.
    """
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def global_index(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Zero-based position in the total order of unique sort keys, without a one-task window.

    A range-partitioned sort is written once to the shared folder; per-partition
    counts (one row per partition) give the offsets.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_mono", 33)
    sized = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_part", "_offset", "_mono")
    )


def _after(value: Column, step: Column, name: str) -> Column:
    """The value behind an affine step; a null value stands for the begin of the key."""
    return F.when(value.isNull(), step[f"_g_{name}"]).otherwise(value * step["_a"] + step[f"_b_{name}"])


def _composed(steps: DataFrame, group: list[str], order: str, names: list[str]) -> DataFrame:
    """Per group its steps in order as the array _steps, and the one step they make together.

    A step maps e to _a * e + _b, and gives _g where it begins the key.
    """
    parts = ["_a", *[f"_{kind}_{name}" for kind in "bg" for name in names]]
    gathered = steps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, *parts))).alias("_steps"))

    def join(acc: Column, step: Column) -> Column:
        moved = {f"_{kind}_{name}": acc[f"_{kind}_{name}"] * step["_a"] + step[f"_b_{name}"] for kind in "bg" for name in names}
        return F.struct((acc["_a"] * step["_a"]).alias("_a"), *[moved[part].alias(part) for part in parts[1:]])

    first = F.struct(*[F.get("_steps", F.lit(0))[part].alias(part) for part in parts])
    whole = F.aggregate(F.slice("_steps", 2, F.size("_steps")), first, join)
    return gathered.withColumn("_whole", whole).select(*group, "_steps", "_whole.*")


def _entries(order: str, names: list[str], start: dict[str, Column]) -> Column:
    """Array of (order, values on entry) for the steps of one row, from the values that the row starts with."""
    values = [f"_e_{name}" for name in names]
    fields = ", ".join([f"{order}: bigint", *[f"{value}: double" for value in values]])

    def walk(acc: Column, step: Column) -> Column:
        here = F.struct(step[order].cast("bigint").alias(order), *[acc[value].alias(value) for value in values])
        moved = [_after(acc[value], step, name).alias(value) for name, value in zip(names, values)]
        return F.struct(F.concat(acc["seen"], F.array(here)).alias("seen"), *moved)

    begin = [start[name].cast("double").alias(value) for name, value in zip(names, values)]
    return F.aggregate("_steps", F.struct(F.array().cast(f"array<struct<{fields}>>").alias("seen"), *begin), walk)["seen"]


def ema(
    df: DataFrame,
    keys: list[str],
    pos: str,
    values: dict[str, str],
    decay: float,
    seed_floor: float | None = None,
    block: int | None = None,
    fan: int = FAN,
    before: DataFrame | None = None,
) -> DataFrame:
    """Exponential moving averages per key; the first value seeds each. Rows in which a value is null are left out.

    With `before`, keys that it has (one row each: keys and the output columns) go on from its averages.
    values maps an output column to an input column. Inside a chunk of consecutive rows the average is a
    closed form over a running sum; a chunk is an affine step of the value before it. Steps are composed
    upwards (chunks of a block, blocks of a group of `fan`, groups of a key) and the values on entry handed
    down again, all as aggregates of short arrays, so no task ever holds a whole key.
    """
    limit = max(1, int(250.0 / -math.log(decay)))  # rows of a chunk: longer ones would overflow the closed form
    d, names = F.lit(float(decay)), list(values)
    df = df.where(reduce(lambda a, b: a & b, [F.col(value).isNotNull() for value in values.values()]))
    cuts = splitters(df, keys, pos, block)
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(pos)) - 1
    local = df.withColumn("_block", block_of(keys, pos, cuts).cast("bigint")).withColumn("_place", place)
    local = local.withColumns({"_chunk": F.floor(F.col("_place") / limit), "_k": F.col("_place") % limit + 1})
    growing = Window.partitionBy(*keys, "_block", "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for name, value in values.items():
        grown = F.sum(F.col(value) * F.pow(d, -F.col("_k"))).over(growing)
        local = local.withColumn(f"_s_{name}", grown).withColumn(f"_f_{name}", F.first(value).over(growing))

    size = F.col("_k")

    def seeded(name: str) -> Column:
        first, total = F.col(f"_f_{name}"), F.col(f"_s_{name}")
        seed = first if seed_floor is None else F.greatest(first, F.lit(seed_floor))
        return F.pow(d, size - 1) * seed + (1.0 - d) * F.pow(d, size) * (total - first / d)

    def moved(name: str) -> Column:
        return (1.0 - d) * F.pow(d, size) * F.col(f"_s_{name}")

    ends = [F.max_by(f"_{part}_{name}", "_k").alias(f"_{part}_{name}") for part in "sf" for name in names]
    chunks = local.groupBy(*keys, "_block", "_chunk").agg(F.max("_k").alias("_k"), *ends).select(
        *keys, "_block", "_chunk", F.pow(d, size).alias("_a"),
        *[moved(name).alias(f"_b_{name}") for name in names], *[seeded(name).alias(f"_g_{name}") for name in names],
    )
    blocks = _composed(chunks, [*keys, "_block"], "_chunk", names).withColumn("_group", F.floor(F.col("_block") / fan))
    groups = _composed(blocks.drop("_steps"), [*keys, "_group"], "_block", names)
    whole = _composed(groups.drop("_steps"), keys, "_group", names)

    if before is None:
        whole = whole.withColumns({f"_e_{name}": F.lit(None).cast("double") for name in names})
    else:
        whole = whole.join(before.select(*keys, *[F.col(name).alias(f"_e_{name}") for name in names]), keys, "left")
    carried = {name: F.col(f"_e_{name}") for name in names}
    group_starts = whole.select(*keys, F.inline(_entries("_group", names, carried)))
    block_starts = groups.select(*keys, "_group", "_steps").join(group_starts, [*keys, "_group"]).select(
        *keys, F.inline(_entries("_block", names, carried))
    )
    chunk_starts = blocks.select(*keys, "_block", "_steps").join(block_starts, [*keys, "_block"]).select(
        *keys, "_block", _entries("_chunk", names, carried).alias("_starts")
    )
    # One row per key and block: the rows keep the partitioning that their window gave them.
    entered = local.join(chunk_starts, [*keys, "_block"]).withColumn("_start", F.get("_starts", F.col("_chunk").cast("int")))

    def average(name: str) -> Column:
        entry = F.col("_start")[f"_e_{name}"]
        return F.when(entry.isNull(), seeded(name)).otherwise(F.pow(d, size) * entry + moved(name))

    return entered.select(*df.columns, *[average(name).alias(name) for name in names])
