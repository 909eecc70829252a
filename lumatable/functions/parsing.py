"""Null-safe parsing and name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text accepted as a number (no type suffixes such as "8.0d").
NUMBER_PATTERN = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
BLANKS = " \t\r\n"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def safe_float(text: Column) -> Column:
    """Double, or null for blank, "None" and anything that is not a number."""
    clean = stripped(text)
    return F.when(clean.rlike(NUMBER_PATTERN), clean.try_cast("double"))


def safe_int(text: Column) -> Column:
    """Whole part of the number: "8.0" is 8 and "8.7" is 8; nan and inf are null."""
    number = safe_float(text)
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def metric_key(text: Column) -> Column:
    """Report key as a column name: lower case, blanks to underscores."""
    return F.replace(F.lower(stripped(text)), F.lit(" "), F.lit("_"))


def list_items(text: Column) -> Column:
    """Split on commas and blanks, dropping empty items."""
    parts = F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+")
    return F.filter(parts, lambda item: item != "")


def fixed_point(value: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, ties to even; format_string alone rounds half up.

    A scaled value that lands on a half may have been rounded there; the exact
    error of the product (by splitting both factors) decides such cases.
    """
    scale = float(10**digits)
    half_bits = float((1 << 27) + 1)
    scale_high = half_bits * scale - (half_bits * scale - scale)
    scale_low = scale - scale_high
    scaled = value * scale
    high = value * half_bits - (value * half_bits - value)
    low = value - high
    error = high * scale_high - scaled + high * scale_low + low * scale_high + low * scale_low
    on_half = scaled - F.floor(scaled) == 0.5
    rounded = (
        F.when(on_half & (error > 0), F.floor(scaled) + 1)
        .when(on_half & (error < 0), F.floor(scaled))
        .otherwise(F.rint(scaled))
    )
    return F.format_string(f"%.{digits}f", rounded.cast("double") / scale)


def number_text(value: Column, digits: int) -> Column:
    """Fixed number of decimals, ties to even; "-" for null and NaN."""
    shown = fixed_point(value, digits)
    return F.when(value.isNull() | F.isnan(value), F.lit("-")).otherwise(shown)


def whole_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def duration_text(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS below one hour; "-" for null; negatives count as zero."""
    total = F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint"))
    hours = F.floor(total / 3600)
    minutes = F.floor(F.pmod(total, F.lit(3600)) / 60)
    rest = F.pmod(total, F.lit(60))
    return (
        F.when(seconds.isNull(), F.lit("-"))
        .when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest))
        .otherwise(F.format_string("%02d:%02d", minutes, rest))
    )


def eta_seconds(elapsed: Column, step: Column, total: Column) -> Column:
    """Remaining time at the pace so far; null before the first or after the last step."""
    return F.when((step > 0) & (total > step), elapsed / step * (total - step))


# Metric names a validation run may ask for, and the two always reported.
SUPPORTED_METRICS = ("psnr", "ssim", "lpips", "semantic_distance", "niqe")
FORCED_METRICS = ("psnr", "ssim")

# Loss weighting schemes and the one accepted misspelling.
WEIGHTING_SCHEMES = ("min_snr", "p2", "edm")
WEIGHTING_ALIAS = {"mini_snr": "min_snr"}

# Preset names, and names that were removed with their successor.
PRESET_NAMES = ("small", "small_throughput", "middle", "max")
REMOVED_PRESETS = {
    "small_sota": "small",
    "small_accum": "small",
    "middle_sota": "middle",
    "middle_accum": "middle",
    "max_accum": "max",
}


def strings(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def metric_names(items: Column) -> Column:
    """Forced metrics first, then the supported requested ones in request order."""
    wanted = F.transform(items, lambda item: F.lower(stripped(item)))
    known = F.filter(wanted, lambda item: item.isin(*SUPPORTED_METRICS))
    return F.array_distinct(F.concat(strings(FORCED_METRICS), known))


def step_counts(items: Column, default: Column) -> Column:
    """Positive step counts in order of first mention, the default appended last."""
    every = F.concat(F.coalesce(items, F.array().cast("array<int>")), F.array(default))
    return F.array_distinct(F.filter(every, lambda item: item > 0))


def weighting_scheme(text: Column) -> Column:
    """Canonical scheme name, or null for an unknown one."""
    name = F.lower(stripped(text))
    for alias, target in WEIGHTING_ALIAS.items():
        name = F.when(name == alias, F.lit(target)).otherwise(name)
    return F.when(name.isin(*WEIGHTING_SCHEMES), name)


def require_known(value: Column, allowed, what: str) -> Column:
    """The value itself; the job fails with a message when it is not allowed."""
    message = F.concat(F.lit(f"Unsupported {what}: "), F.coalesce(value, F.lit("null")))
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(message))


def preset_path(name: Column) -> Column:
    """Preset file for a name; null for a removed name, a path is kept as it is."""
    chosen = F.when(name.isNull() | (name == ""), F.lit("small")).otherwise(name)
    return (
        F.when(chosen.isin(*REMOVED_PRESETS), F.lit(None).cast("string"))
        .when(chosen.isin(*PRESET_NAMES), F.concat(F.lit("configs/train/"), chosen, F.lit(".yaml")))
        .otherwise(chosen)
    )


def known_preset_path(name: Column) -> Column:
    """As preset_path; a removed name fails the job with a message that names its replacement."""
    path = preset_path(name)
    for removed, replacement in REMOVED_PRESETS.items():
        message = f"Legacy config '{removed}' has been removed. Please use '{replacement}' instead."
        path = F.when(name == removed, F.raise_error(F.lit(message))).otherwise(path)
    return path


def safe_divide(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)
