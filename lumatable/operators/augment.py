"""Training augmentation: one draw per pair, applied alike to both images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatable.functions import draws
from lumatable.operators import pixels

# Rotation range in degrees and chance of a flip.
ROTATION = (-5.0, 5.0)
FLIP = 0.5


def draw_params(ident: Column, h: Column, w: Column, size: int, seed: int = 42) -> dict[str, Column]:
    """Crop corner, angle and flip of one pair."""
    return {
        "top": draws.whole_between(ident, "crop/top", 0, h - size, seed),
        "left": draws.whole_between(ident, "crop/left", 0, w - size, seed),
        "angle": draws.between(ident, "angle", *ROTATION, seed),
        "flip": (draws.unit(ident, "flip", seed) > FLIP).cast("int"),
    }


def augment(px: DataFrame, size: int, values: list[str], seed: int = 42) -> DataFrame:
    """Crop, rotate and flip; the values of both images ride in the same pixel rows."""
    params = draw_params(F.col("image_id"), F.col("h"), F.col("w"), size, seed)
    cropped = pixels.crop(px.withColumns({"_t": params["top"], "_l": params["left"]}), F.col("_t"), F.col("_l"), F.lit(size))
    turned = pixels.rotate(cropped.drop("_t", "_l"), params["angle"], values)
    return pixels.hflip(turned, params["flip"] == 1)
