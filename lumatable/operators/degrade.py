"""Low-light degradation of 8-bit RGB pixel tables, step by step and as one job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumatable.functions import colour, draws
from lumatable.operators import pixels, strips

# Ranges of the random parameters; a single number is a probability.
RANGES = {
    "gamma": (1.5, 4.0),
    "linear_attenuation": (0.25, 0.7),
    "saturation_factor": (0.4, 0.85),
    "color_shift_factor": (0.0, 0.12),
    "headlight_boost": (0.0, 0.9),
    "noise_k": (0.005, 0.04),
    "noise_sigma_read": (2.0, 15.0),
    "vignette_prob": 0.5,
    "vignette_strength": (0.2, 0.6),
    "motion_blur_prob": 0.2,
    "motion_blur_kernel": (3, 9),
    "jpeg_artifact_prob": 0.3,
    "jpeg_quality": (40, 85),
}
# Parameters used when nothing is drawn.
FIXED_PARAMS = {
    "gamma": 2.5,
    "linear_attenuation": 0.5,
    "saturation_factor": 0.6,
    "color_shift_factor": 0.1,
    "headlight_boost": 0.5,
    "noise_k": 0.02,
    "noise_sigma_read": 5.0,
    "use_vignette": 0,
    "vignette_strength": 0.0,
    "use_motion_blur": 0,
    "motion_blur_kernel": 5,
    "motion_blur_angle": 0.0,
    "use_jpeg": 0,
    "jpeg_quality": 70,
}
# Ranges of one light (position and radii as shares of the image), and
# the number of lights by image area relative to 512 x 512.
LIGHT = {
    "cx": (0.1, 0.9),
    "cy": (0.4, 0.95),
    "rx": (0.08, 0.35),
    "ry": (0.06, 0.25),
    "sharpness": (0.8, 3.5),
    "intensity": (0.2, 1.0),
}
LIGHT_AREA, LIGHT_STEPS, MOST_LIGHTS = 512 * 512, ((0.35, 1), (0.75, 2)), 4
LIGHT_BLUR = 0.04
EXPOSURE_RANGE = (0.10, 0.55)
EXPOSURE_FLOOR = 1.0
LIFT = 0.35
# Smoothing kernels a blur of automatic sigma uses for small sizes.
SMALL_KERNELS = {
    1: (1.0,),
    3: (0.25, 0.5, 0.25),
    5: (0.0625, 0.25, 0.375, 0.25, 0.0625),
    7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125),
}
PARAMS = tuple(FIXED_PARAMS)
RGB = ("r", "g", "b")
DARK = ("dr", "dg", "db")


def draw_params(ident: Column, ranges: dict | None = None, seed: int = 42) -> dict[str, Column]:
    """The fourteen parameters of one image, drawn from ranges that may be overridden."""
    r = {**RANGES, **(ranges or {})}

    def uniform(name: str) -> Column:
        return draws.between(ident, name, *r[name], seed)

    low, high = r["motion_blur_kernel"]
    odd = low + 2 * draws.whole_between(ident, "motion_blur_kernel", 0, (high - low) // 2, seed)
    drawn = {name: uniform(name) for name in PARAMS if name in r and name not in ("motion_blur_kernel", "jpeg_quality")}
    return {
        **drawn,
        "use_vignette": draws.chance(ident, "vignette", r["vignette_prob"], seed),
        "use_motion_blur": draws.chance(ident, "motion_blur", r["motion_blur_prob"], seed),
        "motion_blur_kernel": odd.cast("int"),
        "motion_blur_angle": draws.between(ident, "motion_blur_angle", 0.0, 180.0, seed),
        "use_jpeg": draws.chance(ident, "jpeg", r["jpeg_artifact_prob"], seed),
        "jpeg_quality": draws.whole_between(ident, "jpeg_quality", *r["jpeg_quality"], seed),
    }


def fixed_params(overrides: dict | None = None) -> dict[str, Column]:
    return {name: F.lit(value) for name, value in {**FIXED_PARAMS, **(overrides or {})}.items()}


def lights(ident: Column, h: Column, w: Column, count: Column | None = None, seed: int = 42) -> Column:
    """Array of light sources of an image: none to four, fewer on small images."""
    share = F.least(F.lit(1.0), h * w / F.lit(float(LIGHT_AREA)))
    most = F.lit(MOST_LIGHTS)
    for bound, number in reversed(LIGHT_STEPS):
        most = F.when(share < bound, number).otherwise(most)
    number = draws.whole_between(ident, "lights", 0, most, seed) if count is None else count

    def light(index: Column) -> Column:
        def part(name: str, scale: Column | None = None) -> Column:
            label = F.concat_ws("/", F.lit("light"), index.cast("string"), F.lit(name))
            value = draws.between(ident, label, *LIGHT[name], seed)
            return value if scale is None else value * scale

        return F.struct(
            part("cx", w).alias("cx"),
            part("cy", h).alias("cy"),
            F.greatest(part("rx", w), F.lit(1.0)).alias("rx"),
            F.greatest(part("ry", h), F.lit(1.0)).alias("ry"),
            part("sharpness").alias("sharpness"),
            part("intensity").alias("intensity"),
        )

    return F.transform(F.slice(F.sequence(F.lit(1), F.lit(MOST_LIGHTS)), 1, number), light)


def light_level(y: Column, x: Column, sources: Column) -> Column:
    """Strongest light at a pixel; zero without lights. At most four sources per image."""

    def level(light: Column) -> Column:
        dx, dy = (x - light["cx"]) / light["rx"], (y - light["cy"]) / light["ry"]
        return F.exp(-(dx * dx + dy * dy) * light["sharpness"]) * light["intensity"]

    return F.coalesce(F.array_max(F.transform(sources, level)), F.lit(0.0))


def auto_taps(size: int) -> np.ndarray:
    """Smoothing kernel whose sigma follows from its size; fixed tables up to seven taps."""
    if size in SMALL_KERNELS:
        return np.array(SMALL_KERNELS[size])
    return strips.gaussian(size, 0.3 * ((size - 1) * 0.5 - 1.0) + 0.8)


def light_blur_size(side: Column) -> Column:
    return F.floor(side * LIGHT_BLUR).cast("int").bitwiseOR(F.lit(1))


def soften_lights(
    px: DataFrame, mask: str, carry: list[str], fixed: list[str] = (), deal: int | None = None
) -> DataFrame:
    """Smooth the light mask; on small images the kernel has one tap."""

    def stencil(grids: strips.Grids, place: strips.Place, given: dict) -> strips.Grids:
        across = strips.along(grids[mask], place, auto_taps(given["x"]), "x", "reflect")
        return {mask: strips.along(across, place, auto_taps(given["y"]), "y", "reflect")}

    sizes = {axis: light_blur_size(F.col(side)) for axis, side in (("x", "w"), ("y", "h"))}
    reach = F.floor(sizes["y"] / 2)
    px = strips.map_pixels(px, stencil, {mask: F.col(mask)}, [mask], reach, pixels.PLANE, carry, fixed, sizes, deal=deal)
    return px.withColumn(mask, colour.clip(F.col(mask)))


def tone_value(v: Column, mask: Column, gamma: Column, attenuation: Column, boost: Column) -> Column:
    """Darkened value channel; lit pixels keep part of the original."""
    glow = mask * boost
    return F.pow(v, gamma) * attenuation * (1.0 - glow) + v * glow


def tone(px: DataFrame, mask: str) -> DataFrame:
    """Gamma, attenuation, glow, saturation and blue shift of 8-bit r, g, b into dr, dg, db."""
    p = {name: F.col(name) for name in PARAMS}
    hue, sat, top = colour.rgb8_to_hsv8(*[F.col(c) for c in RGB])
    hsv = px.withColumns({"_h": hue, "_s": sat, "_v": top / 255.0})
    final = tone_value(F.col("_v"), F.col(mask), p["gamma"], p["linear_attenuation"], p["headlight_boost"])
    dark = hsv.withColumns(
        {
            "_vf": final,
            "_s": colour.to_uint8(F.col("_s") * p["saturation_factor"]),
        }
    )
    back = colour.hsv8_to_rgb8(F.col("_h"), F.col("_s"), colour.to_uint8(F.col("_vf") * 255.0))
    shift = p["color_shift_factor"] * (1.0 - F.col(mask)) * colour.clip(1.0 - F.col("_vf")) * 255.0
    mixed = (back[0] - shift * 0.5, back[1], back[2] + shift)
    return dark.withColumns({name: colour.to_uint8(value) for name, value in zip(DARK, mixed)}).drop(
        "_h", "_s", "_v", "_vf"
    )


def vignette_factor(y: Column, x: Column, h: Column, w: Column, strength: Column) -> Column:
    cy, cx = h / 2.0, w / 2.0
    distance = ((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (cx * cx + cy * cy)
    return colour.clip(1.0 - strength * distance)


def vignette(px: DataFrame) -> DataFrame:
    factor = vignette_factor(F.col("y"), F.col("x"), F.col("h"), F.col("w"), F.col("vignette_strength"))
    used = F.when(F.col("use_vignette") == 1, factor).otherwise(1.0)
    return px.withColumns({name: colour.to_uint8(F.col(name) * used) for name in DARK})


def motion_kernel(size: int, degrees: float) -> np.ndarray:
    """Line kernel of odd size, rotated about its centre and sampled bilinearly; its sum is one."""
    size = max(3, size | 1)
    radius, turn = size // 2, np.radians(degrees)
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    place = dx * np.cos(turn) - dy * np.sin(turn) + radius
    across = np.maximum(0.0, 1.0 - np.abs(dx * np.sin(turn) + dy * np.cos(turn)))
    raw = across * np.clip(np.minimum(place + 1.0, size - place), 0.0, 1.0) / size
    return raw / (raw.sum() + 1e-8)


def motion_blur(px: DataFrame, deal: int | None = None) -> DataFrame:
    """Blur dr, dg, db of images that drew a motion kernel; all other columns ride along."""

    def stencil(grids: strips.Grids, place: strips.Place, given: dict) -> strips.Grids:
        if given["on"] != 1:
            return grids
        kernel = motion_kernel(int(given["size"]), given["angle"])
        radius, steps = len(kernel) // 2, np.argwhere(kernel > 0)
        return {
            name: sum(kernel[j, i] * strips.shifted(grid, place, j - radius, i - radius, "reflect") for j, i in steps)
            for name, grid in grids.items()
        }

    fixed = [c for c in PARAMS if c in px.columns]
    carry = [c for c in px.columns if c not in ("image_id", "h", "w", "y", "x", *DARK, *fixed)]
    drawn = {"on": F.col("use_motion_blur"), "size": F.col("motion_blur_kernel"), "angle": F.col("motion_blur_angle")}
    reach = F.when(drawn["on"] == 1, F.floor(F.greatest(drawn["size"], F.lit(3)) / 2)).otherwise(0)
    inputs = {name: F.col(name) for name in DARK}
    blurred = strips.map_pixels(px, stencil, inputs, list(DARK), reach, pixels.PLANE, carry, fixed, drawn, deal=deal)
    return blurred.withColumns({name: F.rint(name).cast("int") for name in DARK})


def noisy(value: Column, ident: Column, channel: str, y: Column, x: Column, k: Column, sigma: Column, seed: int = 42) -> Column:
    """Shot noise (Poisson of the signal) plus read noise, clipped and truncated to 8 bits."""
    place = F.concat_ws("/", F.lit(channel), y.cast("string"), x.cast("string"))
    spread = sigma * draws.between(ident, F.lit(f"sigma/{channel}"), 0.8, 1.2, seed)
    shot = F.when(k > 0, draws.poisson(ident, F.concat(F.lit("shot/"), place), value * k, seed) / k).otherwise(value)
    return colour.to_uint8(shot + draws.normal(ident, F.concat(F.lit("read/"), place), seed) * spread)


def noise(px: DataFrame, seed: int = 42) -> DataFrame:
    ident, y, x = F.col("image_id"), F.col("y"), F.col("x")
    k, sigma = F.col("noise_k"), F.col("noise_sigma_read")
    return px.withColumns({name: noisy(F.col(name), ident, name, y, x, k, sigma, seed) for name in DARK})


def exposure_stats(px: DataFrame, floor: float = EXPOSURE_FLOOR) -> DataFrame:
    """Mean luma of both sides of 8-bit pixels and their ratio, one row per image."""
    source, dark = (F.avg(colour.luma8_thousandths(*[F.col(c) for c in side])) / 1000.0 for side in (RGB, DARK))
    means = px.groupBy("image_id").agg(source.alias("source_mean"), dark.alias("dark_mean"))
    return means.withColumn("ratio", F.col("dark_mean") / F.greatest("source_mean", F.lit(floor)))


def guarded(source: Column, dark: Column, ratio: Column, low: float, high: float, top: float) -> Column:
    """Lift an image that came out too dark, scale down one that stayed too bright."""
    alpha = colour.clip((low - ratio) / max(low, 1e-6))
    lifted = dark * (1.0 - alpha) + source * alpha * LIFT
    scaled = dark * (high / F.greatest(ratio, F.lit(1e-6)))
    return colour.clip(F.when(ratio < low, lifted).when(ratio > high, scaled).otherwise(dark), 0.0, top)


def exposure_guard(
    px: DataFrame, low: float = EXPOSURE_RANGE[0], high: float = EXPOSURE_RANGE[1],
    floor: float = EXPOSURE_FLOOR, eight_bit: bool = True, exact: bool = True,
) -> DataFrame:
    """Keep the luma ratio of every image inside [low, high].

    The means are windows over the image, so the pixels before them are made once and need no exchange.
    Means of 8-bit values are sums of whole numbers, exact in any order of the pixels: a lifted value may be
    whole, and the last bit of the ratio then decides what it is cut to. Without `exact` lumas are summed as
    doubles, in the order of the rows.
    """
    image = Window.partitionBy("image_id")

    def mean(side: tuple[str, ...]) -> Column:
        channels = [F.col(c) for c in side]
        if eight_bit and exact:
            return F.avg(colour.luma8_thousandths(*channels)).over(image) / 1000.0
        return F.avg(colour.luma(*channels)).over(image)

    source_mean, dark_mean = mean(RGB), mean(DARK)
    joined = px.withColumn("ratio", dark_mean / F.greatest(source_mean, F.lit(floor)))
    top = 255.0 if eight_bit else 1.0
    results = {}
    for source, dark in zip(RGB, DARK):
        value = guarded(F.col(source), F.col(dark), F.col("ratio"), low, high, top)
        results[dark] = F.floor(value).cast("int") if eight_bit else value
    return joined.withColumns(results).drop("ratio")


def degrade(
    images: DataFrame, params: dict[str, Column], seed: int = 42, partitions: int | None = None
) -> DataFrame:
    """Whole degradation of images with interleaved 8-bit RGB data: (image_id, h, w, y, x, r, g, b, dr, dg, db).

    Image rows are shuffled once, strips of lines after each of the two stencils; pixels never. Parameters and lights are drawn
    per image row, before any pixel is unpacked. The JPEG step is left out; its two parameters are
    drawn all the same.
    """
    drawn = pixels.by_image(images, partitions).withColumns(params)
    rows = drawn.withColumn("lights", lights(F.col("image_id"), F.col("h"), F.col("w"), seed=seed))
    px = pixels.rgb_pixels(rows, keep=[*PARAMS, "lights"])
    px = px.withColumns({c: F.col(c).cast("int") for c in RGB})
    px = px.withColumn("mask", light_level(F.col("y"), F.col("x"), F.col("lights"))).drop("lights")
    deal = pixels.partition_count(images, partitions)
    px = soften_lights(px, "mask", list(RGB), list(PARAMS), deal)
    px = noise(motion_blur(vignette(tone(px, "mask")), deal), seed)
    return exposure_guard(px).select("image_id", "h", "w", "y", "x", *RGB, *DARK)


def checked(images: DataFrame, channels: int = 3) -> DataFrame:
    """Image rows with `ok` and, where an image cannot be processed, the `error`.

    An image is refused if its file was not decoded (an `ok` column of 0), if it has no pixels, or if its data
    are missing, of the wrong length, or hold a value that is none.
    """
    size, want = F.size("data"), F.col("h") * F.col("w") * channels
    decoded = F.col("ok") == 0 if "ok" in images.columns else F.lit(False)
    error = (
        F.when(decoded, "not decoded")
        .when(F.coalesce(F.least("h", "w"), F.lit(0)) < 1, "no pixels")
        .when(F.col("data").isNull(), "no data")
        .when(size != want, F.concat(F.lit("expected "), want.cast("string"), F.lit(" values, found "), size.cast("string")))
        .when(F.exists("data", lambda v: v.isNull() | F.isnan(v.cast("double"))), "missing values")
    )
    return images.withColumn("error", error).withColumn("ok", F.col("error").isNull())


def degrade_batch(
    images: DataFrame, params: dict[str, Column], seed: int = 42, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(pixels, outcome): the degradation of all images that can be processed, and one row (image_id, ok, error) each.

    A broken image is counted and fails nothing. `runs.job_outcome` sums the outcome up.
    """
    marked = checked(images)
    done = degrade(marked.where("ok").drop("ok", "error"), params, seed, partitions)
    return done, marked.select("image_id", "ok", "error")
