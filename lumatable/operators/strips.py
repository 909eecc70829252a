"""Stencils on strips of images.

A strip is a stretch of whole lines of one image plane, with the lines above and below it that a stencil
reaches. It is one row that holds its values as arrays, so the number of rows does not grow with the
kernel, and an image larger than a task is many strips. Inside a strip a stencil is NumPy arithmetic on
a (lines, width) grid per value; Spark cuts, deals out and puts together the strips.

Strips come from image rows with whole value arrays (`of_images`: slices, no pixel is unpacked) or from
a pixel table (`map_pixels`, `sum_pixels`: one grouping on the image, which needs no exchange where the
pixels are partitioned by it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 17  # places of a strip, its halo aside; two lines at least
DOUBLES = T.ArrayType(T.DoubleType())


@dataclass
class Place:
    """Where a strip lies: the image's shape, the first line held, and the first and number of its own lines."""

    h: int
    w: int
    first: int
    own: int
    n_own: int

    def inner(self, grid: np.ndarray) -> np.ndarray:
        """The strip's own lines of a grid."""
        return grid[self.own - self.first : self.own - self.first + self.n_own]


Grids = dict[str, np.ndarray]
Stencil = Callable[[Grids, Place, dict], dict]


# ---------------------------------------------------------------------------
# Arithmetic on grids
# ---------------------------------------------------------------------------


def mirror(place: np.ndarray, size: int) -> np.ndarray:
    """Index that a place outside an axis is mirrored onto; the edge itself is not repeated."""
    period = max(2 * (size - 1), 1)
    wrapped = place % period
    return np.zeros_like(place) if size == 1 else np.where(wrapped < size, wrapped, period - wrapped)


def shifted(grid: np.ndarray, place: Place, dy: int, dx: int, border: str) -> np.ndarray:
    """The grid's values at (y + dy, x + dx): zero or mirrored beyond the image.

    Lines outside the strip's halo stand for nothing; a stencil's reach keeps them from its own lines.
    """
    rows, columns = np.arange(len(grid)) + place.first + dy, np.arange(place.w) + dx
    moved = grid
    if dy:
        held = np.clip(mirror(rows, place.h) - place.first, 0, len(grid) - 1)
        moved = moved[held]
    if dx:
        moved = moved[:, mirror(columns, place.w)]
    if border == "zero" and (dy or dx):
        moved = moved * ((rows >= 0) & (rows < place.h))[:, None] * ((columns >= 0) & (columns < place.w))
    return moved


def along(grid: np.ndarray, place: Place, taps: np.ndarray, axis: str, border: str) -> np.ndarray:
    """Correlation with a kernel along one axis: the grid is extended once, then summed in shifted slices."""
    radius, n = len(taps) // 2, grid.shape[0 if axis == "y" else 1]
    reached = np.arange(-radius, n + len(taps) - 1 - radius) + (place.first if axis == "y" else 0)
    size = place.h if axis == "y" else place.w
    held = np.clip(mirror(reached, size) - place.first, 0, n - 1) if axis == "y" else mirror(reached, size)
    wide = grid[held] if axis == "y" else grid[:, held]
    if border == "zero":
        inside = (reached >= 0) & (reached < size)
        wide = wide * (inside[:, None] if axis == "y" else inside)
    total = np.zeros_like(grid)
    for k, weight in enumerate(taps):
        if weight:
            total += weight * (wide[k : k + n] if axis == "y" else wide[:, k : k + n])
    return total


def separable(grid: np.ndarray, place: Place, taps: np.ndarray, border: str) -> np.ndarray:
    return along(along(grid, place, taps, "x", border), place, taps, "y", border)


def gaussian(size: int, sigma: float) -> np.ndarray:
    """Normalised Gaussian kernel."""
    raw = np.exp(-(((np.arange(size) - (size - 1) / 2) / sigma) ** 2) / 2)
    return raw / raw.sum()


def blur_size(sigma: float) -> int:
    """Odd kernel size for a sigma: at least 3, about 4 sigma wide."""
    return max(3, int(np.rint(sigma * 4.0)) | 1)


# ---------------------------------------------------------------------------
# Cutting
# ---------------------------------------------------------------------------


def strip_lines(cells: int | None = None) -> Column:
    """Own lines of a strip; an even number, so that pairs of lines stay together."""
    return (2 * F.greatest(F.floor(F.lit(cells or CELLS) / (2 * F.greatest("w", F.lit(1)))), F.lit(1))).cast("int")


def of_images(images: DataFrame, arrays: list[str], reach: int, cells: int | None = None, spread: bool = False) -> DataFrame:
    """Strip rows of image rows (image_id, h, w, row-major value arrays): _strip, _place and the slices.

    With `spread` the strips are dealt out over all tasks, for images that a task cannot hold.
    """
    size = strip_lines(cells)
    cut = images.withColumn("_lines", size).withColumn(
        "_strip", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / F.col("_lines")).cast("int")))
    )
    own = F.col("_strip") * F.col("_lines")
    first = F.greatest(F.lit(0), own - reach)
    last = F.least(F.col("h"), own + F.col("_lines") + reach)
    place = F.struct(
        F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), first.cast("int").alias("first"),
        own.cast("int").alias("own"), F.least(F.col("_lines"), F.col("h") - own).cast("int").alias("n_own"),
    )
    cut = cut.withColumn("_place", place).withColumns(
        {
            name: F.slice(name, (first * F.col("w") + 1).cast("int"), ((last - first) * F.col("w")).cast("int")).cast("array<double>")
            for name in arrays
        }
    ).drop("_lines")
    return cut.repartition("image_id", "_strip") if spread else cut


def places(place: pd.DataFrame) -> list[Place]:
    return [Place(*map(int, row)) for row in place[["h", "w", "first", "own", "n_own"]].itertuples(index=False, name=None)]


def sum_strips(strips: DataFrame, arrays: list[str], stencil: Stencil, sums: list[str], keys: list[str]) -> DataFrame:
    """Per key, the sums that a stencil returns for the strips' own lines."""
    result = T.StructType([T.StructField(name, T.DoubleType()) for name in sums])

    @F.pandas_udf(result)
    def run(place: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at, columns in zip(places(place), zip(*(values[name] for name in arrays), strict=True), strict=True):
            grids = {name: np.asarray(v, dtype=float).reshape(-1, at.w) for name, v in zip(arrays, columns, strict=True)}
            out.append(stencil(grids, at, {}))
        return pd.DataFrame(out, columns=sums, dtype=float)

    made = strips.select(*keys, run("_place", F.struct(*arrays)).alias("_out"))
    return made.groupBy(*keys).agg(*[F.sum(f"_out.{name}").alias(name) for name in sums])


# ---------------------------------------------------------------------------
# Pixel tables
# ---------------------------------------------------------------------------


def _cells(
    px: DataFrame, inputs: dict[str, Column], reach: Column, planes: list[str], carry: list[str], fixed: list[str], cells: int | None
) -> DataFrame:
    """One row per strip of a pixel table, its places with values and carried columns in the array _cells."""
    size = strip_lines(cells)
    named = [expr.cast("double").alias(f"_in_{name}") for name, expr in inputs.items()]
    held = px.select(*planes, "h", "w", "y", "x", *fixed, *carry, *named, size.alias("_lines"), reach.cast("int").alias("_reach"))
    low = F.floor(F.greatest(F.col("y") - F.col("_reach"), F.lit(0)) / F.col("_lines"))
    high = F.floor(F.least(F.col("y") + F.col("_reach"), F.col("h") - 1) / F.col("_lines"))
    dealt = held.withColumn("_strip", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    places = F.struct("y", "x", *carry, *[f"_in_{name}" for name in inputs])
    return dealt.groupBy(*planes, "h", "w", "_strip").agg(
        F.collect_list(places).alias("_cells"), F.first("_lines").alias("_lines"), *[F.first(c).alias(c) for c in fixed]
    )


def _grids(inputs: list[str], own: int, n_own: int, h: int, w: int, y, x, columns) -> tuple[Grids, Place, tuple]:
    first = int(y.min())
    shape, at = (int(y.max()) - first + 1, w), (y - first, x)
    grids = {}
    for name, values in zip(inputs, columns, strict=True):
        grids[name] = np.zeros(shape)
        grids[name][at] = values
    return grids, Place(h, w, first, own, min(n_own, h - own)), at


def _run_cells(stripped: DataFrame, inputs: list[str], settings: dict[str, Column], result: T.StructType, finish: Callable) -> DataFrame:
    """Adds _out: what `finish(grids, place, settings, places)` gives for each strip."""
    names = list(settings)

    @F.pandas_udf(result)
    def run(shape: pd.DataFrame, values: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = zip(
            shape["own"], shape["n_own"], shape["h"], shape["w"], values["y"], values["x"],
            zip(*(values[name] for name in inputs), strict=True), zip(*(given[name] for name in ["_", *names]), strict=True),
            strict=True,
        )
        for own, n_own, h, w, y, x, columns, constants in rows:
            grids, place, at = _grids(inputs, int(own), int(n_own), int(h), int(w), np.asarray(y), np.asarray(x), columns)
            out.append(finish(grids, place, dict(zip(names, constants[1:], strict=True)), at))
        return pd.DataFrame(out, columns=result.names)

    shape = F.struct((F.col("_strip") * F.col("_lines")).alias("own"), F.col("_lines").alias("n_own"), "h", "w")
    values = F.struct(F.col("_cells.y").alias("y"), F.col("_cells.x").alias("x"), *[F.col(f"_cells._in_{n}").alias(n) for n in inputs])
    given = F.struct(F.lit(0).alias("_"), *[expr.alias(name) for name, expr in settings.items()])
    return stripped.withColumn("_out", run(shape, values, given))


def map_pixels(
    px: DataFrame, stencil: Stencil, inputs: dict[str, Column], outputs: list[str], reach: Column,
    planes: list[str], carry: list[str] = (), fixed: list[str] = (), settings: dict[str, Column] | None = None, cells: int | None = None,
    deal: int | None = None,
) -> DataFrame:
    """(planes, h, w, fixed, y, x, carry, outputs): what a stencil makes of the inputs at every pixel.

    `carry` columns keep their value per pixel; `fixed` ones are the same all over a plane and ride
    once per strip. `settings` are expressions of planes, h, w and fixed columns that the stencil gets.
    `reach` is the number of lines it looks up or down. A plane should hold every place of its image;
    places that it lacks count as zero.

    Spark forgets the partitioning behind a Python function. Where image windows or further stencils
    follow, `deal` strips to so many partitions by the planes: strips are compact, their pixels are not.
    """
    stripped = _cells(px, inputs, reach, planes, list(carry), list(fixed), cells)
    result = T.StructType([T.StructField(name, DOUBLES) for name in outputs])

    def finish(grids: Grids, place: Place, given: dict, at: tuple) -> tuple:
        made = stencil(grids, place, given)
        return tuple(made[name][at] for name in outputs)

    done = _run_cells(stripped, list(inputs), settings or {}, result, finish)
    # From here on only what leaves the strips: the stencil's inputs stay behind.
    held = {name: F.col(f"_cells.{name}").alias(f"_c_{name}") for name in ("y", "x", *carry)}
    made = {name: F.col(f"_out.{name}").alias(f"_o_{name}") for name in outputs}
    own = (F.col("_strip") * F.col("_lines")).alias("_own")
    done = done.select(*planes, "h", "w", *fixed, own, "_lines", *held.values(), *made.values())
    done = done.repartition(deal, *planes) if deal else done
    zipped = F.arrays_zip(*[f"_c_{name}" for name in held], *[f"_o_{name}" for name in made])
    flat = done.select(*planes, "h", "w", *fixed, "_own", "_lines", F.explode(zipped).alias("_v"))
    mine = (F.col("_v._c_y") >= F.col("_own")) & (F.col("_v._c_y") < F.col("_own") + F.col("_lines"))
    return flat.where(mine).select(
        *planes, "h", "w", *fixed, *[F.col(f"_v._c_{name}").alias(name) for name in held],
        *[F.col(f"_v._o_{name}").alias(name) for name in made],
    )


def sum_pixels(
    px: DataFrame, stencil: Stencil, inputs: dict[str, Column], sums: list[str], reach: int, planes: list[str],
    keys: list[str], cells: int | None = None,
) -> DataFrame:
    """Per key (some of the planes), the sums that a stencil returns for its strips' own lines."""
    stripped = _cells(px, inputs, F.lit(reach), planes, [], [], cells)
    result = T.StructType([T.StructField(name, T.DoubleType()) for name in sums])

    def finish(grids: Grids, place: Place, given: dict, at: tuple) -> tuple:
        made = stencil(grids, place, given)
        return tuple(float(made[name]) for name in sums)

    done = _run_cells(stripped, list(inputs), {}, result, finish)
    return done.groupBy(*keys).agg(*[F.sum(f"_out.{name}").alias(name) for name in sums])
