"""Colour arithmetic on r, g, b columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights.
LUMA = (0.299, 0.587, 0.114)
FLOAT_EPS = 1.1920929e-07


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def luma8_thousandths(r: Column, g: Column, b: Column) -> Column:
    """Luma of 8-bit values times 1000: whole numbers, whose sums are exact."""
    return 299 * r + 587 * g + 114 * b


def hvi(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Intensity, red chroma, blue chroma."""
    intensity = luma(r, g, b)
    return intensity, r - intensity, b - intensity


def to_model_space(value: Column, image_max: Column) -> Column:
    """Scale to [-1, 1]; an image still on the 0-255 scale is divided once more."""
    return F.when(image_max > 1.5, value / 255.0).otherwise(value) * 2.0 - 1.0


def from_model_space(value: Column) -> Column:
    return clip(value / 2.0 + 0.5)


def residual_target(clean: Column, low: Column, scale: float) -> Column:
    return (clean - low) * F.lit(float(scale))


def residual_decoded(low: Column, residual: Column, scale: float) -> Column:
    return clip(low + residual / F.lit(max(float(scale), 1e-6)), -1.0, 1.0)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Float form: hue in degrees, saturation and value in [0, 1]."""
    top = F.greatest(r, g, b)
    spread = top - F.least(r, g, b)
    scale = 60.0 / (spread + FLOAT_EPS)
    hue = (
        F.when(top == r, (g - b) * scale)
        .when(top == g, (b - r) * scale + 120.0)
        .otherwise((r - g) * scale + 240.0)
    )
    return F.when(hue < 0, hue + 360.0).otherwise(hue), spread / (F.abs(top) + FLOAT_EPS), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Float form, hue in degrees. Each channel is a hat function of the hue."""

    def channel(offset: float) -> Column:
        place = F.pmod(F.lit(offset) + h / 60.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(place, 4.0 - place, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


def rgb8_to_hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit form: hue in half degrees 0-179, saturation and value 0-255, 12-bit fixed point."""
    top = F.greatest(r, g, b)
    spread = top - F.least(r, g, b)
    sat_step = F.when(top > 0, F.rint(F.lit(255.0 * 4096) / top)).otherwise(0).cast("bigint")
    hue_step = F.when(spread > 0, F.rint(F.lit(180.0 * 4096) / (6.0 * spread))).otherwise(0).cast("bigint")
    turn = F.when(top == r, g - b).when(top == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)
    hue = F.shiftright(turn * hue_step + F.lit(2048), 12)
    sat = F.shiftright(spread * sat_step + F.lit(2048), 12)
    return F.when(hue < 0, hue + 180).otherwise(hue).cast("int"), sat.cast("int"), top.cast("int")


def hsv8_to_rgb8(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV back to 8-bit RGB through the float form, rounded half to even."""
    parts = hsv_to_rgb(h * 2.0, s / 255.0, v / 255.0)
    return tuple(F.rint(part * 255.0).cast("int") for part in parts)


def to_uint8(value: Column) -> Column:
    """Clip to 0-255 and truncate."""
    return F.floor(clip(value, 0.0, 255.0)).cast("int")
