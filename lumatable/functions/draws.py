"""Repeatable random draws: a hash of id, seed and label, never rand().

rand() changes with the partitioning and after a lost task; a hash does not.
MD5 is used so that any SQL engine can reproduce a draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumatable.functions.binding import bound

_RANGE = float(1 << 32)


def unit(ident: Column, label: str | Column, seed: int = 42) -> Column:
    """Uniform draw in [0, 1) for one id and one label."""
    label = F.lit(label) if isinstance(label, str) else label
    digest = F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed)), label))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_RANGE)


def between(ident: Column, label, low, high, seed: int = 42) -> Column:
    low = F.lit(float(low)) if not isinstance(low, Column) else low
    high = F.lit(float(high)) if not isinstance(high, Column) else high
    return low + unit(ident, label, seed) * (high - low)


def chance(ident: Column, label, probability, seed: int = 42) -> Column:
    return (unit(ident, label, seed) < F.lit(probability)).cast("int")


def whole_between(ident: Column, label, low, high, seed: int = 42) -> Column:
    """Whole number in [low, high], both ends included."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return (low + F.floor(unit(ident, label, seed) * (high - low + 1))).cast("int")


def normal(ident: Column, label: str | Column, seed: int = 42) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    label = F.lit(label) if isinstance(label, str) else label
    first = unit(ident, F.concat(label, F.lit("/1")), seed)
    second = unit(ident, F.concat(label, F.lit("/2")), seed)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2.0 * math.pi) * second)


def poisson_steps(target: Column, mean: Column) -> Column:
    """Number of steps, from the empty sum, in which a walk over a Poisson distribution passes the target (below 1).

    Bernstein's inequality: a count exceeds its mean by t with a chance of at most exp(-t * t / (2 * (mean + t / 3))).
    """
    far = -F.log(F.lit(1.0) - target)
    reach = far / 3.0 + F.sqrt(far * far / 9.0 + 2.0 * mean * far)
    return F.ceil(mean + reach).cast("int") + 3


def poisson(ident: Column, label: str | Column, mean: Column, seed: int = 42) -> Column:
    """Poisson draw by walking the cumulative distribution up to a uniform draw.

    The walk is as long as its draw needs, not as the smallest tail a 32-bit uniform can reach. Terms are kept
    as logarithms, so that large means do not start from zero. The hash is computed once, and a step
    uses the last step's results, so each logarithm and power is too.
    """

    def walk(given: Column) -> Column:
        steps = poisson_steps(given["target"], given["mean"])
        # The logarithm of the next term, the sum of those before it, and how many sums lie below the draw: the first, of none, does.
        start = F.struct((-given["mean"]).alias("log"), F.lit(0.0).alias("total"), F.lit(-1).alias("n"))

        def step(acc: Column, index: Column) -> Column:
            return F.struct(
                (acc["log"] + given["log_mean"] - F.log(index)).alias("log"),
                # A mean of zero has no logarithm.
                (acc["total"] + F.coalesce(F.exp(acc["log"]), F.lit(0.0))).alias("total"),
                (acc["n"] + F.when(acc["total"] <= given["target"], 1).otherwise(0)).alias("n"),
            )

        return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["n"])

    signal = mean.cast("double")
    given = F.struct(unit(ident, label, seed).alias("target"), signal.alias("mean"), F.log(signal).alias("log_mean"))
    return bound(given, walk)
