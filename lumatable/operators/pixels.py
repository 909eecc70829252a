"""Pixel tables and the ways to combine pixels.

A pixel table has one row per pixel: image_id, h, w, y, x and value columns; more
columns (a channel, say) may be added to `planes`, the keys of one 2-D plane.

Blurs and other stencils work on strips of lines (`strips`). Resizes and rotations are
scatters: a source pixel emits its weighted contributions to output places, and a
grouped sum collects them. Weights are expressions, never a join on pixels.

Image rows are compact, their pixels are some twenty times larger. `by_image`
partitions the rows by image_id before they are unpacked; unpacking keeps that
partitioning, so grouped sums, windows and joins on image_id and coordinates need
no further shuffle. Image ids are unique rows, hence no id is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import tables
from lumatable.functions.binding import bound
from lumatable.operators import strips

PLANE = ["image_id"]


def by_image(images: DataFrame, partitions: int | None = None) -> DataFrame:
    """Partition image rows by image_id before they are unpacked.

    The default count is spark.sql.shuffle.partitions; a fixed count also keeps AQE
    from merging partitions whose rows look small but whose pixels are not.
    """
    return images.repartition(partition_count(images, partitions), "image_id")


def partition_count(df: DataFrame, partitions: int | None = None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gray_pixels(images: DataFrame, data: str = "data", keep: list[str] = ()) -> DataFrame:
    """(image_id, h, w, y, x, v) from one row-major array per image; no shuffle."""
    flat = images.select("image_id", "h", "w", *keep, F.posexplode(data).alias("_i", "v"))
    return flat.select("image_id", "h", "w", *keep, *_grid(F.col("_i")), F.col("v").cast("double").alias("v"))


def pair_pixels(images: DataFrame, first: str = "a", second: str = "b", keep: list[str] = ()) -> DataFrame:
    """(…, a, b) from two arrays of the same image row: pairs are joined as images, not as pixels."""
    zipped = F.arrays_zip(first, second).cast("array<struct<a:double,b:double>>")
    flat = images.select("image_id", "h", "w", *keep, F.posexplode(zipped).alias("_i", "_v"))
    return flat.select("image_id", "h", "w", *keep, *_grid(F.col("_i")), "_v.a", "_v.b")


def rgb_pixels(images: DataFrame, data: str = "data", keep: list[str] = (), also: dict[str, str] | None = None) -> DataFrame:
    """(…, r, g, b) from interleaved RGB arrays; the arrays are not carried along the pixels.

    also maps a prefix to a further array column of the same shape, for pairs that
    were joined as image rows.
    """
    arrays = {"": data, **(also or {})}
    places = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    fields = [(prefix + n, column, c) for prefix, column in arrays.items() for c, n in enumerate("rgb")]
    values = F.transform(
        places, lambda i: F.struct(*[F.get(column, i * 3 + c).cast("double").alias(n) for n, column, c in fields])
    )
    flat = images.select("image_id", "h", "w", *keep, F.posexplode(values).alias("_i", "_v"))
    return flat.select("image_id", "h", "w", *keep, *_grid(F.col("_i")), *[f"_v.{n}" for n, _, _ in fields])


def _grid(index: Column) -> list[Column]:
    return [F.floor(index / F.col("w")).cast("int").alias("y"), (index % F.col("w")).cast("int").alias("x")]


def channels_long(rgb: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(…, channel, v): one row per pixel and channel."""
    return rgb.unpivot(["image_id", "h", "w", "y", "x", *keep], ["r", "g", "b"], "channel", "v")


# ---------------------------------------------------------------------------
# Stencils and one axis at a time
# ---------------------------------------------------------------------------


def blur_reach(sigma: Column) -> Column:
    """Half the kernel size of a blur: kernels are odd, about 4 sigma wide and 3 at least."""
    return F.floor(F.greatest(F.lit(3), F.rint(sigma * 4.0).cast("int").bitwiseOR(F.lit(1))) / 2).cast("int")


def separable(
    px: DataFrame, weights: np.ndarray, values: list[str], border: str,
    planes: list[str] = PLANE, carry: list[str] = (), fixed: list[str] = (), deal: int | None = None,
) -> DataFrame:
    """Correlate value columns with the same fixed weights along both axes; borders are "zero" or "reflect"."""

    def stencil(grids: strips.Grids, place: strips.Place, given: dict) -> strips.Grids:
        return {name: strips.separable(grid, place, weights, border) for name, grid in grids.items()}

    inputs = {name: F.col(name) for name in values}
    return strips.map_pixels(px, stencil, inputs, values, F.lit(len(weights) // 2), planes, carry, fixed, deal=deal)


def blur_maps(
    px: DataFrame, widths: dict[str, Column], maps: dict[str, tuple[str, Column]],
    planes: list[str] = PLANE, carry: list[str] = (), fixed: list[str] = (), deal: int | None = None,
) -> DataFrame:
    """Several maps blurred in one pass, mirrored border.

    widths names the sigmas, as expressions of h, w and fixed columns; maps gives each output a width and
    a source expression.
    """
    sigmas = {name: F.greatest(sigma.cast("double"), F.lit(1e-3)) for name, sigma in widths.items()}
    width_of = {name: width for name, (width, _) in maps.items()}

    def stencil(grids: strips.Grids, place: strips.Place, given: dict) -> strips.Grids:
        kernels = {name: strips.gaussian(strips.blur_size(sigma), sigma) for name, sigma in given.items()}
        return {name: strips.separable(grids[name], place, kernels[width], "reflect") for name, width in width_of.items()}

    reach = F.greatest(*[blur_reach(sigma) for sigma in sigmas.values()], F.lit(1))
    inputs = {name: expr for name, (_, expr) in maps.items()}
    return strips.map_pixels(px, stencil, inputs, list(maps), reach, planes, carry, fixed, sigmas, deal=deal)


def gaussian_blur(
    px: DataFrame, sigma: Column, values: list[str], planes: list[str] = PLANE, carry: list[str] = ()
) -> DataFrame:
    """Blur value columns with a sigma per shape (an expression of h and w), mirrored border."""
    return blur_maps(px, {"k": sigma}, {name: ("k", F.col(name)) for name in values}, planes, carry)


def _resize_axis(px: DataFrame, axis: str, target: str, values: list[str], keep: list[str], planes: list[str]) -> DataFrame:
    """Bilinear resize of one axis to the size in a column.

    A source index reaches the outputs whose place lies within one step of it.
    """
    size, index, goal = F.col("h" if axis == "y" else "w"), F.col(axis), F.col(target)
    low = F.greatest(F.floor((index - 0.5) * goal / size - 0.5), F.lit(0))
    high = F.least(F.ceil((index + 1.5) * goal / size - 0.5), goal - 1)
    # The last source index also serves every place beyond it, the first every place before it.
    low = F.when(index == 0, 0).otherwise(low).cast("int")
    high = F.when(index == size - 1, goal - 1).otherwise(high).cast("int")
    place = F.greatest((F.col("_o") + 0.5) * size / goal - 0.5, F.lit(0.0))
    base = F.least(F.floor(F.col("_place")), size - 1)
    part = F.col("_place") - base
    weight = F.when(index == base, 1.0 - part).otherwise(0.0) + F.when(
        index == F.least(base + 1, size - 1), part
    ).otherwise(0.0)
    other = "x" if axis == "y" else "y"
    return (
        px.where(low <= high)
        .withColumn("_o", F.explode(F.sequence(low, high)))
        .withColumn("_place", place)
        .withColumn("_k", weight)
        .where(F.col("_k") > 0)
        .groupBy(*planes, *keep, other, F.col("_o").alias(axis))
        .agg(*[F.sum(F.col(name) * F.col("_k")).alias(name) for name in values])
    )


def resize(px: DataFrame, height: Column, width: Column, values: list[str], planes: list[str] = PLANE) -> DataFrame:
    """Bilinear resize to a height and width per image; images already that size stay as they are."""
    aimed = px.withColumn("_th", height.cast("int")).withColumn("_tw", width.cast("int"))
    across = _resize_axis(aimed, "x", "_tw", values, ["h", "w", "_th", "_tw"], planes)
    down = _resize_axis(across, "y", "_th", values, ["_th", "_tw"], planes)
    return down.select(*planes, F.col("_th").alias("h"), F.col("_tw").alias("w"), "y", "x", *values)


def _axis_weights(shapes: DataFrame, size: str, goal: str) -> DataFrame:
    """Per pair of sizes the weights as one array of (output place, source place, weight)."""
    spark = shapes.sparkSession
    tables.register(spark)
    lateral = f"SELECT {size}, {goal}, o, s, k FROM {{sizes}}, LATERAL resize_weights({size}, {goal})"
    made = spark.sql(lateral, sizes=shapes.select(size, goal).distinct())
    return made.groupBy(size, goal).agg(F.collect_list(F.struct("o", "s", "k")).alias(f"_taps{goal}"))


def resize_rows(images: DataFrame, height: Column, width: Column, data: str = "data") -> DataFrame:
    """Bilinear resize of image rows (image_id, h, w, row-major grey array): h, w and the array change.

    Weights come from the table function once per pair of sizes, as arrays; few and short, they meet the
    image rows in a join that Spark broadcasts, and no pixel is a row.
    """
    aimed = images.withColumns({"_th": height.cast("int"), "_tw": width.cast("int")})
    rows = aimed.join(_axis_weights(aimed, "h", "_th"), ["h", "_th"]).join(_axis_weights(aimed, "w", "_tw"), ["w", "_tw"])

    @F.pandas_udf("array<double>")
    def weigh(values: pd.Series, shape: pd.DataFrame, down: pd.DataFrame, across: pd.DataFrame) -> pd.Series:
        out = []
        for k, (v, h, w, th, tw) in enumerate(zip(values, *(shape[c] for c in ("h", "w", "_th", "_tw")), strict=True)):
            matrices = []
            for taps, goal, size in ((down, th, h), (across, tw, w)):
                matrix = np.zeros((goal, size))
                matrix[taps["o"].iat[k], taps["s"].iat[k]] = taps["k"].iat[k]
                matrices.append(matrix)
            out.append((matrices[0] @ np.asarray(v, dtype=float).reshape(h, w) @ matrices[1].T).reshape(-1))
        return pd.Series(out, dtype=object)

    def arrays(name: str) -> Column:
        return F.struct(*[F.col(name)[part].alias(part) for part in ("o", "s", "k")])

    done = rows.withColumn(data, weigh(data, F.struct("h", "w", "_th", "_tw"), arrays("_taps_th"), arrays("_taps_tw")))
    return done.withColumns({"h": F.col("_th"), "w": F.col("_tw")}).select(*images.columns)


def shrink_target(size: int) -> tuple[Column, Column]:
    """Target shape of a resize that only happens when a side exceeds the size."""
    over = (F.col("h") > size) | (F.col("w") > size)
    return F.when(over, size).otherwise(F.col("h")), F.when(over, size).otherwise(F.col("w"))


def match_target(low_h: Column, low_w: Column, size: int) -> tuple[Column, Column]:
    """Common shape of a pair: that of the low image, or the training size when it is too small."""
    small = F.least(low_h, low_w) < size
    return F.when(small, size).otherwise(low_h), F.when(small, size).otherwise(low_w)


# ---------------------------------------------------------------------------
# Two axes at once
# ---------------------------------------------------------------------------


def crop(pixels: DataFrame, top: Column, left: Column, size: Column) -> DataFrame:
    moved = pixels.withColumns({"_top": top, "_left": left, "_size": size})
    y, x = F.col("y") - F.col("_top"), F.col("x") - F.col("_left")
    inside = (y >= 0) & (y < F.col("_size")) & (x >= 0) & (x < F.col("_size"))
    kept = moved.where(inside).withColumns({"y": y.cast("int"), "x": x.cast("int")})
    return kept.withColumns({"h": F.col("_size").cast("int"), "w": F.col("_size").cast("int")}).drop(
        "_top", "_left", "_size"
    )


def hflip(pixels: DataFrame, when: Column = None) -> DataFrame:
    mirrored = F.col("w") - 1 - F.col("x")
    return pixels.withColumn("x", mirrored if when is None else F.when(when, mirrored).otherwise(F.col("x")))


def _hat(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(distance))


def rotate(px: DataFrame, degrees: Column, values: list[str], planes: list[str] = PLANE) -> DataFrame:
    """Rotate about the centre, counter-clockwise, bilinear, zero outside.

    A source pixel reaches only outputs within two steps of its rotated place. It
    also adds nothing to its own place, so outputs without a source stay as zeros.
    """
    theta = F.radians(degrees)
    centre_y, centre_x = (F.col("h") - 1) / 2.0, (F.col("w") - 1) / 2.0
    steps = [(j, i, False) for j in range(-2, 3) for i in range(-2, 3)] + [(0, 0, True)]
    near = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit(own).alias("own")) for j, i, own in steps])
    turned = px.withColumns(
        {
            "_cos": F.cos(theta),
            "_sin": F.sin(theta),
            "_dy": F.col("y") - centre_y,
            "_dx": F.col("x") - centre_x,
        }
    )
    forward_y = F.rint(F.col("_dy") * F.col("_cos") - F.col("_dx") * F.col("_sin") + centre_y).cast("int")
    forward_x = F.rint(F.col("_dx") * F.col("_cos") + F.col("_dy") * F.col("_sin") + centre_x).cast("int")
    reached = turned.withColumns({"_fy": forward_y, "_fx": forward_x}).withColumn("_n", F.explode(near))
    own = F.col("_n.own")
    out_y = F.when(own, F.col("y")).otherwise(F.col("_fy") + F.col("_n.j"))
    out_x = F.when(own, F.col("x")).otherwise(F.col("_fx") + F.col("_n.i"))
    reached = reached.withColumns({"_oy": out_y, "_ox": out_x})
    rel_y, rel_x = F.col("_oy") - centre_y, F.col("_ox") - centre_x
    source_y = rel_x * F.col("_sin") + rel_y * F.col("_cos")
    source_x = rel_x * F.col("_cos") - rel_y * F.col("_sin")
    weight = F.when(own, 0.0).otherwise(_hat(F.col("_dy") - source_y) * _hat(F.col("_dx") - source_x))
    inside = F.col("_oy").between(0, F.col("h") - 1) & F.col("_ox").between(0, F.col("w") - 1)
    landed = reached.withColumn("_k", weight).where(inside & (own | (F.col("_k") > 0)))
    return landed.groupBy(*planes, "h", "w", F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(
        *[F.sum(F.col(name) * F.col("_k")).alias(name) for name in values]
    )


def motion_taps(ksize: Column, degrees: Column) -> Column:
    """Line kernel of odd size, rotated about its centre: array of (dy, dx, k) summing to one.

    A rotated line sampled bilinearly has a closed form: a hat across the line
    times a ramp at its two ends.
    """
    odd = F.greatest(F.lit(3), ksize.bitwiseOR(F.lit(1)))
    given = F.struct(
        odd.alias("size"),
        F.floor(odd / 2).alias("radius"),
        F.cos(F.radians(degrees)).alias("cos"),
        F.sin(F.radians(degrees)).alias("sin"),
    )

    def raw(g: Column) -> Column:
        def tap(place: Column) -> Column:
            dy = F.floor(place / g["size"]) - g["radius"]
            dx = place % g["size"] - g["radius"]
            along = dx * g["cos"] - dy * g["sin"] + g["radius"]
            across = dx * g["sin"] + dy * g["cos"]
            ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along + 1.0, g["size"] - along))
            weight = _hat(across) * ramp / g["size"]
            return F.struct(dy.cast("int").alias("dy"), dx.cast("int").alias("dx"), weight.alias("k"))

        places = F.sequence(F.lit(0), g["size"] * g["size"] - 1)
        return F.filter(F.transform(places, tap), lambda t: t["k"] > 0)

    def normalised(taps: Column) -> Column:
        total = F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["k"]) + 1e-8

        def share(whole: Column) -> Column:
            return F.transform(
                taps, lambda t: F.struct(t["dy"].alias("dy"), t["dx"].alias("dx"), (t["k"] / whole).alias("k"))
            )

        return bound(total, share)

    return bound(bound(given, raw), normalised)


def correlate(
    px: DataFrame, taps: str, values: list[str], planes: list[str] = PLANE, carry: list[str] = (), fixed: list[str] = ()
) -> DataFrame:
    """2-D correlation with a mirrored border; `taps` is an array column of (dy, dx, k), the same all over a plane."""

    def stencil(grids: strips.Grids, place: strips.Place, given: dict) -> strips.Grids:
        kernel = list(zip(given["dy"], given["dx"], given["k"], strict=True))
        return {
            name: sum(k * strips.shifted(grid, place, int(dy), int(dx), "reflect") for dy, dx, k in kernel)
            for name, grid in grids.items()
        }

    reach = F.array_max(F.transform(F.col(taps), lambda t: F.abs(t["dy"])))
    settings = {part: F.col(taps)[part] for part in ("dy", "dx", "k")}
    inputs = {name: F.col(name) for name in values}
    return strips.map_pixels(px, stencil, inputs, values, reach, planes, carry, [*fixed, taps], settings).drop(taps)


# ---------------------------------------------------------------------------
# Value statistics
# ---------------------------------------------------------------------------


def histogram(rgb: DataFrame) -> DataFrame:
    """Count per channel and 8-bit value over all 256 bins; empty bins are zero."""
    spark = rgb.sparkSession
    counted = rgb.unpivot([], ["r", "g", "b"], "channel", "value").groupBy("channel", "value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    bins = spark.range(256).select(
        F.explode(F.array(F.lit("r"), F.lit("g"), F.lit("b"))).alias("channel"), F.col("id").cast("int").alias("value")
    )
    return bins.join(counted, ["channel", "value"], "left").select(
        "channel", "value", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_pixels")
    )


def model_space(images: DataFrame, value: str = "v", data: str = "data") -> DataFrame:
    """Grey pixels on [-1, 1]; the guard against a 0-255 scale is a maximum taken on the image row."""
    from lumatable.functions.colour import to_model_space

    topped = gray_pixels(images.withColumn("_top", F.array_max(data)), data, keep=["_top"])
    return topped.withColumn(value, to_model_space(F.col("v"), F.col("_top"))).drop("_top")


def neighbour_difference(pixels: DataFrame, value: str, planes: list[str] = PLANE) -> DataFrame:
    """Absolute difference to the next pixel below (_down) and to the right (_right); null at the edge.

    A window holds one row or one column of a plane, never a whole image.
    """
    below = Window.partitionBy(*planes, "x").orderBy("y")
    right = Window.partitionBy(*planes, "y").orderBy("x")
    return pixels.withColumn("_down", F.abs(F.lead(value).over(below) - F.col(value))).withColumn(
        "_right", F.abs(F.lead(value).over(right) - F.col(value))
    )
