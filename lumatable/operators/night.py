"""Class-aware day-to-night synthesis on RGB pixel tables in [0, 1] with a label per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumatable.functions import colour, draws
from lumatable.operators import components, degrade, pixels, strips
from lumatable.operators.catalog import CLASS_GROUPS, LABEL_IDS, require_labels

# Class settings in the order they are blended: gamma, attenuation, saturation.
BASE_SETTING = (1.65, 0.22, 0.55)
CLASS_SETTINGS = (
    ("sky", 1.00, 0.58, 0.60),
    ("road", 1.35, 0.28, 0.65),
    ("building", 1.45, 0.24, 0.40),
    ("vegetation", 1.55, 0.20, 0.32),
    ("vehicle", 1.25, 0.34, 0.72),
    ("person", 1.38, 0.28, 0.58),
    ("sign", 1.12, 0.34, 0.84),
    ("light", 1.00, 0.78, 1.00),
)
# Sky colours, noise, stars and asset matching.
SKY_TOP, SKY_BOTTOM = (0.018, 0.028, 0.110), (0.070, 0.100, 0.180)
SKY_NOISE, STAR_SHARE, STAR_SIGMA, STAR_SIZE = 0.006, 0.0009, 1.3, 5
STAR_COLOUR = (0.12, 0.25, 0.40)
ASSET_SCALE, ASSET_TINT = (0.20, 0.55), (0.72, 0.82, 0.92)
SKY_COVERAGE, SKY_LARGEST = (0.02, 0.7), 0.1
# Blur widths as shares of the longer side.
SOFT_SIGMA, POOL_SIGMA, AMBIENT_SIGMA, ROAD_SIGMA, EMISSIVE_SIGMA = 0.01, 0.022, 0.05, 0.012, 0.008
# Mixing weights of illumination and emission.
FOCUS = {"road": 1.0, "light": 0.8, "vehicle": 0.45, "sign": 0.15}
INFLUENCE = {"road": 1.0, "building": 0.45, "vehicle": 0.35}
EMISSIVE = {"light": 1.0, "sign": 0.5, "vehicle": 0.25}
POOL_COLOUR, ROAD_COLOUR, AMBIENT_BLUE = (0.08, 0.06, 0.03), (0.12, 0.10, 0.08), 0.015
LIGHT_LIMIT, EMISSIVE_MIX = 0.16, 0.22
EXPOSURE_RANGE, EXPOSURE_FLOOR = (0.08, 0.60), 1e-6

RGB = ("r", "g", "b")
GROUPS = tuple(CLASS_GROUPS[LABEL_IDS])


def mask_name(group: str) -> str:
    return f"m_{group}"


def class_masks(px: DataFrame, space: str = LABEL_IDS, label: str = "label_id") -> DataFrame:
    """One soft mask column per class group."""
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in px.columns else F.lit(1.0)
    soft = colour.clip(confidence.cast("double"))
    return px.withColumns(
        {mask_name(g): F.when(F.col(label).isin(*ids), soft).otherwise(0.0) for g, ids in CLASS_GROUPS[space].items()}
    )


def mix(weights: dict[str, float]) -> Column:
    """Weighted sum of class masks, clipped."""
    return colour.clip(sum((F.col(mask_name(g)) * weight for g, weight in weights.items()), F.lit(0.0)))


def longer_side() -> Column:
    return F.greatest("h", "w")


def height_share() -> Column:
    """0 at the top row, 1 at the bottom row."""
    return F.when(F.col("h") > 1, F.col("y") / (F.col("h") - 1)).otherwise(0.0)


def sky_usable(px: DataFrame, tile: int = components.TILE) -> DataFrame:
    """(image_id, coverage, largest_share, usable) of the sky mask."""
    coverage = px.groupBy("image_id").agg(F.avg(mask_name("sky")).alias("coverage"))
    sky = px.where(F.col(mask_name("sky")) > 0.5)
    share = components.largest_share(coverage, components.components(sky, tile))
    usable = F.col("coverage").between(*SKY_COVERAGE) & (F.col("largest_share") > SKY_LARGEST)
    return coverage.join(share, "image_id").select("image_id", "coverage", "largest_share", usable.cast("int").alias("usable"))


def gradient_sky(channel: int) -> Column:
    share = height_share()
    return SKY_TOP[channel] * (1.0 - share) + SKY_BOTTOM[channel] * share


def noisy_sky(channel: int, seed: int = 42) -> Column:
    """Gradient sky with a little noise per pixel and channel."""
    label = F.concat_ws("/", F.lit(f"sky{channel}"), F.col("y").cast("string"), F.col("x").cast("string"))
    return colour.clip(gradient_sky(channel) + draws.normal(F.col("image_id"), label, seed) * SKY_NOISE)


def star(seed: int = 42) -> Column:
    label = F.concat_ws("/", F.lit("star"), F.col("y").cast("string"), F.col("x").cast("string"))
    return (draws.unit(F.col("image_id"), label, seed) < STAR_SHARE).cast("double")


def render_gradient_sky(px: DataFrame, randomize: bool, seed: int = 42) -> DataFrame:
    """sky_r, sky_g, sky_b columns of a rendered night sky."""
    if not randomize:
        return px.withColumns(rendered_sky(False))
    weights = strips.gaussian(STAR_SIZE, STAR_SIGMA)
    carry = [c for c in px.columns if c not in ("image_id", "h", "w", "y", "x")]
    starred = px.withColumn("_star", star(seed))
    lit = pixels.separable(starred, weights, ["_star"], "reflect", carry=carry, deal=pixels.partition_count(px))
    return lit.withColumns(rendered_sky(True, seed)).drop("_star")


def rendered_sky(randomize: bool, seed: int = 42) -> dict[str, Column]:
    """The sky's columns; a random one has noise and the blurred stars of column `_star`."""
    if not randomize:
        return {f"sky_{c}": gradient_sky(i) for i, c in enumerate(RGB)}
    return {f"sky_{c}": colour.clip(noisy_sky(i, seed) + F.col("_star") * STAR_COLOUR[i]) for i, c in enumerate(RGB)}


def pick_asset(ident: Column, n_assets: int, seed: int = 42) -> Column:
    """Index of the sky asset of an image."""
    return draws.whole_between(ident, "asset", 0, n_assets - 1, seed)


def attach_assets(px: DataFrame, images: DataFrame, assets: DataFrame, n_assets: int, seed: int = 42) -> DataFrame:
    """sky_* columns from asset pixels (asset_id, h, w, y, x, r, g, b), each fitted once to every shape that uses it.

    Null where the asset has no pixels. Joins pixels; `with_assets` does the same for image rows.
    """
    asset = pick_asset(F.col("image_id"), n_assets, seed).alias("asset_id")
    wanted = images.select(asset, F.col("h").alias("_ah"), F.col("w").alias("_aw")).distinct()
    sky = fit_assets(assets, wanted).select("asset_id", "h", "w", "y", "x", *[F.col(c).alias(f"sky_{c}") for c in RGB])
    chosen = px.select("*", asset)
    return chosen.join(sky, ["asset_id", "h", "w", "y", "x"], "left").drop("asset_id")


def fit_assets(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asset pixels resized to the shapes (asset_id, _ah, _aw) that are wanted of them."""
    return pixels.resize(assets.join(wanted, "asset_id"), F.col("_ah"), F.col("_aw"), list(RGB), ["asset_id"])


def with_assets(rows: DataFrame, assets: DataFrame, n_assets: int, seed: int = 42, name: str = "sky") -> DataFrame:
    """Image rows with the array of their asset's sky, fitted once per asset and shape; null where there is none.

    Unpack it with the image (`rgb_pixels(rows, also={"sky_": "sky"})`): sky and image meet as rows, and no
    pixel of either is shuffled.
    """
    asset = pick_asset(F.col("image_id"), n_assets, seed)
    chosen = rows.withColumn("_asset", asset)
    wanted = chosen.select(F.col("_asset").alias("asset_id"), F.col("h").alias("_ah"), F.col("w").alias("_aw")).distinct()
    places = F.array_sort(F.collect_list(F.struct("y", "x", F.array(*[F.col(c).cast("double") for c in RGB]).alias("v"))))
    whole = fit_assets(assets, wanted).groupBy(F.col("asset_id").alias("_asset"), "h", "w").agg(F.flatten(places["v"]).alias(name))
    return chosen.join(whole, ["_asset", "h", "w"], "left").drop("_asset")


def sky_scale(source: Column, asset: Column) -> Column:
    return colour.clip(F.greatest(source, F.lit(0.03)) / F.greatest(asset, F.lit(1e-4)), *ASSET_SCALE)


def match_sky(px: DataFrame) -> DataFrame:
    """Scale an asset sky to the source's brightness and tint it; images without sky pixels keep theirs."""
    under, image = F.col(mask_name("sky")) > 0.05, Window.partitionBy("image_id")
    means = {f"source_{c}": F.avg(F.when(under, F.col(c))).over(image) for c in RGB}
    means |= {f"asset_{c}": F.avg(F.when(under, F.col(f"sky_{c}"))).over(image) for c in RGB}
    joined = px.withColumns(means)
    matched = {}
    for c, tint in zip(RGB, ASSET_TINT):
        sky = F.col(f"sky_{c}")
        scaled = colour.clip(sky * sky_scale(F.col(f"source_{c}"), F.col(f"asset_{c}")) * tint)
        # The greater and the lesser of a value and null is the value, so null is asked for first.
        matched[f"sky_{c}"] = F.when(sky.isNull() | F.col(f"source_{c}").isNull(), sky).otherwise(scaled)
    return joined.withColumns(matched).drop(*[f"{side}_{c}" for side in ("source", "asset") for c in RGB])


def near_field() -> Column:
    return colour.clip(0.10 + 0.90 * F.pow(height_share(), F.lit(1.6)))


def blurred_maps(
    px: DataFrame, carry: list[str], fixed: list[str] = (), deal: int | None = None,
    stars: Column | None = None, with_masks: bool = True,
) -> DataFrame:
    """Every blurred map of the synthesis, and `_star` of given stars, in one pass; class masks ride along if asked to."""
    side = longer_side()
    widths = {
        "soft": side * SOFT_SIGMA,
        "pool": F.greatest(F.lit(3.0), side * POOL_SIGMA),
        "ambient": side * AMBIENT_SIGMA,
        "road": side * ROAD_SIGMA,
        "emissive": side * EMISSIVE_SIGMA,
    }
    maps = {f"soft_{g}": ("soft", F.col(mask_name(g))) for g in GROUPS} | {
        "pool": ("pool", F.col("_pool")),
        "ambient": ("ambient", F.col(mask_name("sky"))),
        "road_glow": ("road", F.col("_road")),
        "emissive": ("emissive", F.col("_emissive")),
    }
    if stars is not None:  # a blur of this width has STAR_SIZE taps
        widths["stars"], maps["_star"] = F.lit(STAR_SIGMA), ("stars", stars)
    mixed = px.withColumns(
        {
            "_pool": mix(FOCUS),
            "_road": colour.clip(F.col(mask_name("road"))) * near_field(),
            "_emissive": mix(EMISSIVE),
        }
    )
    masks = [mask_name(g) for g in GROUPS] if with_masks else []
    return pixels.blur_maps(mixed, widths, maps, carry=[*carry, *masks], fixed=fixed, deal=deal)


def setting(index: int) -> Column:
    """Gamma, attenuation or saturation map: ordered blends over the soft class masks."""
    value = F.lit(BASE_SETTING[index])
    for group, *targets in CLASS_SETTINGS:
        soft = F.col(f"soft_{group}")
        value = value * (1.0 - soft) + targets[index] * soft
    return value


def darken(px: DataFrame, source=RGB, out=RGB) -> DataFrame:
    """Class-aware darkening in HSV."""
    hue, sat, top = colour.rgb_to_hsv(*[F.col(c) for c in source])
    maps = px.withColumns({"_h": hue, "_s": sat, "_v": colour.clip(top)}).withColumns(
        {"_gamma": setting(0), "_atten": setting(1), "_sat": setting(2)}
    )
    dark = maps.withColumns(
        {
            "_s": colour.clip(F.col("_s") * F.col("_sat")),
            "_v": colour.clip(F.pow(F.col("_v"), F.col("_gamma")) * F.col("_atten")),
        }
    )
    back = colour.hsv_to_rgb(F.col("_h"), F.col("_s"), F.col("_v"))
    return dark.withColumns({name: colour.clip(value) for name, value in zip(out, back)}).drop(
        "_h", "_s", "_v", "_gamma", "_atten", "_sat"
    )


def warm_pool(strength: Column) -> Column:
    falloff = colour.clip(0.20 + 0.80 * F.pow(height_share(), F.lit(1.8)))
    return colour.clip(F.col("pool") * falloff * strength)


def pool_strength(randomize: bool, seed: int = 42) -> Column:
    return draws.between(F.col("image_id"), "pool", 0.70, 1.00, seed) if randomize else F.lit(1.0)


def illumination(strength: Column) -> dict[str, Column]:
    """Added light per channel from blurred maps and masks."""
    pool, share = warm_pool(strength), height_share()
    spread = pool * mix(INFLUENCE) * near_field()
    road = F.col("road_glow") * colour.clip(pool * 1.2 + 0.25 * F.col(mask_name("vehicle")))
    ambient = F.col("ambient") * AMBIENT_BLUE * (1.0 - 0.55 * share)
    light = {}
    for i, c in enumerate(RGB):
        value = spread * POOL_COLOUR[i] + road * ROAD_COLOUR[i]
        light[c] = colour.clip(value + ambient if c == "b" else value, 0.0, LIGHT_LIMIT)
    return light


def emissive(image: Column, source: Column) -> Column:
    """Blend lamps, signs and vehicles toward the brighter of image and source."""
    part = F.col("emissive") * EMISSIVE_MIX
    return colour.clip(image * (1.0 - part) + F.greatest(image, source) * part)


def synthesize(
    px: DataFrame, images: DataFrame, space: str = LABEL_IDS, randomize: bool = True,
    assets: DataFrame | None = None, n_assets: int = 0, apply_base_noise: bool = True, seed: int = 42,
    tile: int = components.TILE,
) -> DataFrame:
    """Night version dr, dg, db of r, g, b in [0, 1] with label_id (and an optional confidence).

    A label outside the space fails the job. Skies come from columns sky_r, sky_g, sky_b (`with_assets`) or
    from asset pixels, matched to the image; images without one get a rendered sky.
    images holds (image_id, h, w) of the same images. Unpack px from rows partitioned
    by image: then only the sky pixels, per-image figures and asset pixels are shuffled.
    """
    label = "label_id"
    masked = class_masks(require_labels(px, space), space)
    usable = sky_usable(masked, tile).select("image_id", "usable")
    # One row per image, far fewer than pixels: those are streamed past it and not sorted.
    flagged = masked.join(usable.hint("shuffle_hash"), "image_id")
    if assets is not None and n_assets:
        flagged = attach_assets(flagged, images, assets, n_assets, seed)
    given = [f"_given_{c}" for c in RGB] if "sky_r" in flagged.columns else []
    if given:
        flagged = match_sky(flagged).withColumnsRenamed({f"sky_{c}": f"_given_{c}" for c in RGB})
    # Stars are blurred with the other maps; masks and the sky's noise are worked out again behind the strips, not carried.
    carry = [*RGB, label, *[c for c in ("confidence",) if c in px.columns], *given]
    stars = star(seed) if randomize else None
    maps = class_masks(blurred_maps(flagged, carry, ["usable"], pixels.partition_count(px), stars, False), space, label)
    skies = rendered_sky(randomize, seed)
    maps = maps.withColumns({n: F.coalesce(f"_given_{n[-1]}", sky) if given else sky for n, sky in skies.items()})
    alpha = F.when(F.col("usable") == 1, F.col("soft_sky")).otherwise(0.0)
    working = maps.withColumns(
        {f"w{c}": colour.clip(F.col(c) * (1.0 - alpha) + F.col(f"sky_{c}") * alpha) for c in RGB}
    )
    dark = darken(working, [f"w{c}" for c in RGB], [f"n{c}" for c in RGB])
    light = illumination(pool_strength(randomize, seed))
    lit = dark.withColumns({f"n{c}": colour.clip(F.col(f"n{c}") + light[c]) for c in RGB})
    boosted = lit.withColumns({f"d{c}": emissive(F.col(f"n{c}"), F.col(c)) for c in RGB})
    result = boosted.select("image_id", "h", "w", "y", "x", *RGB, *degrade.DARK)
    if not apply_base_noise:
        return result
    return degrade.exposure_guard(result, *EXPOSURE_RANGE, EXPOSURE_FLOOR, eight_bit=False)
