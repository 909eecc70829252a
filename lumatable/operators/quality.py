"""Paired-image quality metrics over a pixel-pair table (planes, h, w, y, x, a, b).

a is the prediction, b the target, both on [0, 1] unless said otherwise. Every
metric returns one row per image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatable.operators import ordered, pixels, strips

# SSIM window, stabilisers, and the small constants of the losses.
SSIM_TAPS, SSIM_SIGMA = 11, 1.5
SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2
CHARBONNIER_EPS = 1e-3
EDGE_EPS = 1e-6
SPECTRA = ("a_re", "a_im", "b_re", "b_im")
SOBEL_SMOOTH, SOBEL_SLOPE = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
EXPOSURE_MARGIN = 0.05
# Default weights of the composite loss.
COMPOSITE_WEIGHTS = {"char": 1.0, "ssim": 0.1, "wavelet": 0.0, "frequency": 0.0, "edge": 0.0}

IMAGE = "image_id"


def _decibel(mse: Column) -> Column:
    """Peak signal-to-noise ratio for a data range of one; null for identical images."""
    return 10.0 * F.log10(1.0 / F.nullif(mse, F.lit(0.0)))


def squared_error(pairs: DataFrame, keep: list[str] = ()) -> DataFrame:
    diff = F.col("a") - F.col("b")
    return pairs.groupBy(IMAGE, *keep).agg(F.sum(diff * diff).alias("sq_error"), F.count(F.lit(1)).alias("n_values"))


def psnr(pairs: DataFrame) -> DataFrame:
    mse = F.col("sq_error") / F.col("n_values")
    return squared_error(pairs).select(IMAGE, mse.alias("mse"), _decibel(mse).alias("psnr"))


def pooled_psnr(errors: DataFrame, order: str, batch_size: int, limit: int | None = None) -> DataFrame:
    """PSNR as a batched validation reports it: one error per batch, batches weighted by size.

    errors has one row per image. Batches follow the file order; with a limit the
    last batch is cut short.
    """
    indexed = ordered.global_index(errors, [order])
    kept = indexed if limit is None else indexed.where(F.col("index") < limit)
    batches = kept.groupBy(F.floor(F.col("index") / batch_size).alias("batch")).agg(
        F.sum("sq_error").alias("sq"), F.sum("n_values").alias("n"), F.count(F.lit(1)).alias("images")
    )
    value = _decibel(F.col("sq") / F.col("n"))
    return batches.select("batch", value.alias("psnr"), "images")


def weighted_batches(batches: DataFrame) -> DataFrame:
    total = F.sum(F.col("psnr") * F.col("images")) / F.sum("images")
    return batches.agg(total.alias("psnr"), F.sum("images").alias("images"))


def ssim(pairs: DataFrame, planes: list[str] = pixels.PLANE) -> DataFrame:
    return score(pairs, ["ssim"], planes=planes)


def charbonnier(pairs: DataFrame, eps: float = CHARBONNIER_EPS) -> DataFrame:
    """Values on [-1, 1]."""
    diff = F.col("a") - F.col("b")
    return pairs.groupBy(IMAGE).agg(F.avg(F.sqrt(diff * diff + eps * eps)).alias("charbonnier"))


def total_variation(image: DataFrame, value: str, planes: list[str] = pixels.PLANE, name: str = "tv") -> DataFrame:
    steps = pixels.neighbour_difference(image, value, planes)
    return steps.groupBy(IMAGE).agg((F.avg("_down") + F.avg("_right")).alias(name))


def wavelet(pairs: DataFrame, planes: list[str] = pixels.PLANE) -> DataFrame:
    """Mean absolute difference of the three Haar detail bands; an odd last row or column is left out."""
    diff = F.col("a") - F.col("b")
    sign_y = F.when(F.col("y") % 2 == 0, 1.0).otherwise(-1.0)
    sign_x = F.when(F.col("x") % 2 == 0, 1.0).otherwise(-1.0)
    even = (F.col("y") < F.col("h") - F.col("h") % 2) & (F.col("x") < F.col("w") - F.col("w") % 2)
    bands = (
        pairs.where(even)
        .groupBy(*planes, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"))
        .agg(*[F.abs(F.sum(diff * sign)).alias(f"_{i}") for i, sign in enumerate((sign_y, sign_x, sign_y * sign_x))])
    )
    return bands.groupBy(IMAGE).agg((F.avg(F.col("_0") + F.col("_1") + F.col("_2")) / 6.0).alias("wavelet"))


@F.pandas_udf(T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in SPECTRA]))
def _half_spectra(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Non-redundant half of the spectrum of each line of both images."""
    out = {name: [] for name in SPECTRA}
    for name, lines in (("a", a), ("b", b)):
        for line in lines:
            spectrum = np.fft.rfft(np.asarray(line, dtype=float))
            out[f"{name}_re"].append(spectrum.real)
            out[f"{name}_im"].append(spectrum.imag)
    return pd.DataFrame(out)


@F.pandas_udf(T.DoubleType())
def _level_difference(a_re: pd.Series, a_im: pd.Series, b_re: pd.Series, b_im: pd.Series, area: pd.Series) -> pd.Series:
    """Summed difference of log magnitudes along each column of half spectra."""

    def level(re, im, n):
        return np.log1p(np.abs(np.fft.fft(np.asarray(re, dtype=float) + 1j * np.asarray(im, dtype=float))) / np.sqrt(n))

    rows = zip(a_re, a_im, b_re, b_im, area, strict=True)
    return pd.Series([float(np.abs(level(p, q, n) - level(r, t, n)).sum()) for p, q, r, t, n in rows], dtype=float)


def _line(values: list[str], axis: str) -> Column:
    """Array of the values of one line, in order of the axis."""
    return F.array_sort(F.collect_list(F.struct(axis, *[F.col(v).cast("double").alias(v) for v in values]))).alias("_line")


def frequency(pairs: DataFrame, planes: list[str] = pixels.PLANE, size: int | None = None) -> DataFrame:
    """Mean absolute difference of log magnitudes of the half spectrum (orthonormal).

    A line of an image is one array, transformed in Arrow batches of lines, first rows and then columns; an
    image spans many lines. With `size`, images larger than that are shrunk first.
    """
    px = pairs if size is None else pixels.resize(pairs, *pixels.shrink_target(size), ["a", "b"], planes)
    rows = px.groupBy(*planes, "h", "w", "y").agg(_line(["a", "b"], "x"))
    parts = list(SPECTRA)
    halves = rows.withColumn("_s", _half_spectra(F.col("_line.a"), F.col("_line.b"))).select(
        *planes, "h", "w", "y", F.posexplode(F.arrays_zip(*[F.col(f"_s.{p}") for p in parts])).alias("x", "_v")
    )
    columns = halves.select(*planes, "h", "w", "y", "x", *[F.col(f"_v.{p}").alias(p) for p in parts])
    columns = columns.groupBy(*planes, "h", "w", "x").agg(_line(parts, "y"))
    total = _level_difference(*[F.col(f"_line.{p}") for p in parts], (F.col("h") * F.col("w")).cast("double"))
    sums = columns.select(IMAGE, "h", total.alias("_total"))
    return sums.groupBy(IMAGE).agg((F.sum("_total") / F.sum("h")).alias("frequency"))


def edge(pairs: DataFrame, planes: list[str] = pixels.PLANE) -> DataFrame:
    """Mean absolute difference of Sobel magnitudes, zero border."""
    return score(pairs, ["edge"], planes=planes)


def _stencil_sums(
    df: DataFrame, values: list[str], stencil: strips.Stencil, sums: list[str], reach: int, planes: list[str] = pixels.PLANE
) -> DataFrame:
    """Sums of a stencil per image, from image rows (arrays) or from a pixel table."""
    if dict(df.dtypes)[values[0]].startswith("array"):
        return strips.sum_strips(strips.of_images(df, values, reach), values, stencil, sums, [IMAGE])
    return strips.sum_pixels(df, stencil, {name: F.col(name) for name in values}, sums, reach, planes, [IMAGE])


def _mean_parts(name: str, values: np.ndarray) -> dict[str, float]:
    """Sum and count of the values that are known."""
    return {f"{name}_sum": float(np.nansum(values)), f"{name}_n": float(np.count_nonzero(~np.isnan(values)))}


def _mean(name: str) -> Column:
    return F.col(f"{name}_sum") / F.nullif(f"{name}_n", F.lit(0.0))


def _steps(grid: np.ndarray, place: strips.Place) -> tuple[np.ndarray, np.ndarray]:
    """Absolute differences to the next place below and to the right of a strip's own lines."""
    start = place.own - place.first
    down = np.abs(np.diff(grid[start : start + place.n_own + 1], axis=0))
    return down, np.abs(np.diff(place.inner(grid), axis=1))


RETINEX = ("low", "r_low", "i_low", "high", "r_high", "i_high")
RETINEX_MEANS = ("recon_low", "recon_high", "consistency", "bright_low", "bright_high", "down_low", "right_low", "down_high", "right_high")


def _retinex_sums(grids: strips.Grids, place: strips.Place, given: dict) -> dict[str, float]:
    low, r_low, i_low, high, r_high, i_high = (place.inner(grids[name]) for name in RETINEX)
    means = {
        "recon_low": np.abs(r_low * i_low - low), "recon_high": np.abs(r_high * i_high - high),
        "consistency": np.abs(r_low - r_high), "bright_low": i_low, "bright_high": i_high,
    }
    for side in ("low", "high"):
        means[f"down_{side}"], means[f"right_{side}"] = _steps(grids[f"i_{side}"], place)
    return {k: v for name, values in means.items() for k, v in _mean_parts(name, values).items()}


def retinex_terms(
    planes_px: DataFrame, consistency_weight: float = 1.0, tv_weight: float = 0.1, exposure_weight: float = 0.1
) -> DataFrame:
    """Decomposition losses from low, high and their reflectance r_* and illumination i_* columns, in one pass.

    Where the high side is null only the low reconstruction counts.
    """
    sums = [f"{name}_{part}" for name in RETINEX_MEANS for part in ("sum", "n")]
    joined = _stencil_sums(planes_px, list(RETINEX), _retinex_sums, sums, 1)
    paired = _mean("recon_high").isNotNull()
    zero = F.lit(0.0)
    tv = {side: _mean(f"down_{side}") + _mean(f"right_{side}") for side in ("low", "high")}
    gap = _mean("bright_high") - _mean("bright_low")
    terms = {
        "l_recon_low": _mean("recon_low"),
        "l_recon_high": F.coalesce(_mean("recon_high"), zero),
        "l_consistency": F.coalesce(_mean("consistency"), zero),
        "l_exposure": F.when(paired, F.greatest(zero, EXPOSURE_MARGIN - gap)).otherwise(zero),
        "l_tv": tv["low"] + F.coalesce(tv["high"], zero),
    }
    total = (
        terms["l_recon_low"]
        + terms["l_recon_high"]
        + consistency_weight * terms["l_consistency"]
        + tv_weight * terms["l_tv"]
        + exposure_weight * terms["l_exposure"]
    )
    return joined.select(
        IMAGE,
        *[value.alias(name) for name, value in terms.items()],
        F.when(paired, total).otherwise(terms["l_recon_low"]).alias("retinex_total"),
    )


# ---------------------------------------------------------------------------
# Several metrics in one pass
# ---------------------------------------------------------------------------


def _squared(a, b, raw, place) -> dict[str, float]:
    return _mean_parts("mse", place.inner(a - b) ** 2)


def _charbonnier_sums(a, b, raw, place) -> dict[str, float]:
    return _mean_parts("charbonnier", np.sqrt(place.inner(raw) ** 2 + CHARBONNIER_EPS**2))


def _ssim_sums(a, b, raw, place) -> dict[str, float]:
    taps = strips.gaussian(SSIM_TAPS, SSIM_SIGMA)
    mean_a, mean_b, aa, bb, ab = (place.inner(strips.separable(v, place, taps, "zero")) for v in (a, b, a * a, b * b, a * b))
    top = (2.0 * mean_a * mean_b + SSIM_C1) * (2.0 * (ab - mean_a * mean_b) + SSIM_C2)
    squares = mean_a * mean_a + mean_b * mean_b
    return _mean_parts("ssim", top / ((squares + SSIM_C1) * (aa + bb - squares + SSIM_C2)))


def _wavelet_sums(a, b, raw, place) -> dict[str, float]:
    """Strips begin on even lines, so no pair of lines is cut."""
    diff = place.inner(a - b)
    even = diff[: diff.shape[0] // 2 * 2, : diff.shape[1] // 2 * 2]
    top, bottom = even[::2, ::2] + even[::2, 1::2], even[1::2, ::2] + even[1::2, 1::2]
    left, right = even[::2, ::2] - even[::2, 1::2], even[1::2, ::2] - even[1::2, 1::2]
    return _mean_parts("wavelet", (np.abs(top - bottom) + np.abs(left + right) + np.abs(left - right)) / 6.0)


def _edge_sums(a, b, raw, place) -> dict[str, float]:
    smooth, slope = np.array(SOBEL_SMOOTH), np.array(SOBEL_SLOPE)

    def magnitude(grid):
        across = strips.along(strips.along(grid, place, slope, "x", "zero"), place, smooth, "y", "zero")
        down = strips.along(strips.along(grid, place, smooth, "x", "zero"), place, slope, "y", "zero")
        return np.sqrt(across**2 + down**2 + EDGE_EPS)

    return _mean_parts("edge", place.inner(np.abs(magnitude(a) - magnitude(b))))


# What a metric declares: the sums it needs of a strip, the lines it looks beyond, and its value from the sums' mean.
METRICS = {
    "psnr": ("mse", _squared, 0, _decibel),
    "charbonnier": ("charbonnier", _charbonnier_sums, 0, lambda mean: mean),
    "ssim": ("ssim", _ssim_sums, SSIM_TAPS // 2, lambda mean: mean),
    "wavelet": ("wavelet", _wavelet_sums, 0, lambda mean: mean),
    "edge": ("edge", _edge_sums, 1, lambda mean: mean),
    "frequency": None,  # needs whole columns too: a second stage over blocks of columns
}


def _spectrum_blocks(a: np.ndarray, b: np.ndarray, place: strips.Place, step: int) -> list[np.ndarray]:
    """The half spectra of a strip's own lines, cut into blocks of columns: (parts, lines, columns) each."""
    spectra = [np.fft.rfft(place.inner(grid), axis=1) for grid in (a, b)]
    parts = np.stack([part for spectrum in spectra for part in (spectrum.real, spectrum.imag)])
    return [parts[:, :, at : at + step].ravel() for at in range(0, parts.shape[2], step)]


@F.pandas_udf(T.DoubleType())
def _block_levels(pieces: pd.Series, h: pd.Series, w: pd.Series, step: pd.Series, block: pd.Series) -> pd.Series:
    """Summed difference of log magnitudes over one block of columns, its pieces in order of the lines."""
    out = []
    for held, height, width, most, at in zip(pieces, h, w, step, block, strict=True):
        columns = min(most, width // 2 + 1 - at * most)
        parts = np.concatenate([np.asarray(piece, dtype=float).reshape(4, -1, columns) for piece in held], axis=1)
        levels = [
            np.log1p(np.abs(np.fft.fft(parts[k] + 1j * parts[k + 1], axis=0)) / np.sqrt(float(height * width))) for k in (0, 2)
        ]
        out.append(float(np.abs(levels[0] - levels[1]).sum()))
    return pd.Series(out, dtype=float)


def _scored_with_spectra(images: DataFrame, reach: int, stencil: strips.Stencil, sums: list[str]) -> DataFrame:
    """The sums per image and, from the same pass over the strips, the metric of the spectra."""
    step = F.greatest(F.floor(F.lit(strips.CELLS) / F.col("h")), F.lit(1)).cast("int")
    cut = strips.of_images(images, ["a", "b"], reach).withColumn("_step", step)
    fields = [T.StructField(name, T.DoubleType()) for name in sums] + [T.StructField("_blocks", T.ArrayType(strips.DOUBLES))]

    @F.pandas_udf(T.StructType(fields))
    def run(place: pd.DataFrame, values: pd.DataFrame, columns: pd.Series) -> pd.DataFrame:
        out = []
        for at, a, b, most in zip(strips.places(place), values["a"], values["b"], columns, strict=True):
            grids = {"a": np.asarray(a, dtype=float).reshape(-1, at.w), "b": np.asarray(b, dtype=float).reshape(-1, at.w)}
            out.append({**stencil(grids, at, {}), "_blocks": stencil(grids, at, {"step": int(most)})})
        return pd.DataFrame(out, columns=[*sums, "_blocks"])

    made = cut.select(IMAGE, "h", "w", "_step", "_strip", run("_place", F.struct("a", "b"), "_step").alias("_out"))
    pieces = made.select(IMAGE, "h", "w", "_step", "_strip", *[f"_out.{name}" for name in sums], F.posexplode("_out._blocks").alias("_block", "_piece"))
    # A strip's sums ride with its first block only.
    own = [F.sum(F.when(F.col("_block") == 0, F.col(name))).alias(name) for name in sums]
    held = F.array_sort(F.collect_list(F.struct("_strip", "_piece")))["_piece"]
    blocks = pieces.groupBy(IMAGE, "h", "w", "_step", "_block").agg(held.alias("_pieces"), *own)
    levels = blocks.select(IMAGE, "h", "w", *sums, _block_levels("_pieces", "h", "w", "_step", "_block").alias("_level"))
    half = F.floor(F.col("w") / 2) + 1
    return levels.groupBy(IMAGE, "h", "w").agg(
        *[F.sum(name).alias(name) for name in sums], (F.sum("_level") / F.first(F.col("h") * half)).alias("frequency")
    )


def score(
    pairs: DataFrame, names: list[str], model: bool = False, planes: list[str] = pixels.PLANE
) -> DataFrame:
    """Named metrics of image pairs, one row per image: one scan and one pass over strips, however many are named.

    pairs holds image rows with value arrays a (the prediction) and b (the target), or pixels with columns
    a and b. Values are on [0, 1]; with `model` they are on [-1, 1], where the charbonnier term is taken, and
    the other metrics see them clipped and moved to [0, 1]. Metrics not named are not computed.
    """
    unknown = sorted(set(names) - set(METRICS))
    if unknown or not names:
        raise ValueError(f"Unsupported metrics: {unknown}. Expected some of {sorted(METRICS)}")
    plain = [METRICS[name] for name in names if METRICS[name]]
    sums = [f"{mean}_{part}" for mean, *_ in plain for part in ("sum", "n")]
    reach = max([reach for *_, reach, _ in plain], default=0)

    def stencil(grids: strips.Grids, place: strips.Place, given: dict):
        raw = grids["a"] - grids["b"]
        a, b = ((np.clip(grids[side], -1.0, 1.0) + 1.0) / 2.0 if model else grids[side] for side in ("a", "b"))
        if given:
            return _spectrum_blocks(a, b, place, given["step"])
        return {k: v for _, find, _, _ in plain for k, v in find(a, b, raw, place).items()}

    if "frequency" in names:
        if not dict(pairs.dtypes)["a"].startswith("array"):
            raise ValueError("the frequency metric is scored on image rows; use frequency() on a pixel table")
        found = _scored_with_spectra(pairs, reach, stencil, sums)
    else:
        found = _stencil_sums(pairs, ["a", "b"], stencil, sums, reach, planes)
    values = {name: F.col("frequency") if METRICS[name] is None else METRICS[name][3](_mean(METRICS[name][0])) for name in names}
    return found.select(IMAGE, *[value.alias(name) for name, value in values.items()])


def composite(model_pairs: DataFrame, weights: dict[str, float], frequency_size: int | None = None) -> DataFrame:
    """Per-image terms and their weighted total from image rows with arrays a and b on [-1, 1].

    Terms with weight zero are not computed. With `frequency_size`, images larger than that are shrunk
    before the frequency term, which then is a pass of its own over their pixels.
    """
    weights = {**COMPOSITE_WEIGHTS, **weights}
    shrunk = frequency_size is not None and weights["frequency"] > 0
    chosen = [name for name in ("wavelet", "frequency", "edge") if weights[name] > 0 and not (shrunk and name == "frequency")]
    terms = score(model_pairs, ["charbonnier", "ssim", *chosen], model=True)
    terms = terms.withColumnRenamed("charbonnier", "char").withColumn("ssim", 1.0 - F.col("ssim"))
    if shrunk:
        unit = {name: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(name))) + 1.0) / 2.0 for name in ("a", "b")}
        terms = terms.join(frequency(pixels.pair_pixels(model_pairs).withColumns(unit), size=frequency_size), IMAGE)
    used = [name for name in weights if name in terms.columns]
    total = sum((F.lit(weights[name]) * F.col(name) for name in used), F.lit(0.0))
    return terms.withColumn("total", total)


def sample_mean(values: Column, weight: Column) -> Column:
    return F.sum(values * weight) / F.greatest(F.sum(weight), F.lit(1e-8))


def feature_distance(first: str | Column, second: str | Column) -> Column:
    """Euclidean distance of two feature vectors, without exploding them."""
    squares = F.zip_with(first, second, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, value: acc + value))
