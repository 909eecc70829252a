"""Table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class ResizeWeights:
    """Bilinear weights of one axis: output place o takes the share k of source place s.

    Places lie at pixel centres; what falls beyond an edge goes to the edge. One or two rows per output place.
    """

    def eval(self, source: int, target: int) -> Iterator[tuple[int, int, float]]:
        if source is None or target is None:
            return
        for o in range(target):
            place = max((o + 0.5) * source / target - 0.5, 0.0)
            low = min(int(place), source - 1)
            share = place - low
            if low == source - 1 or not share:
                yield o, low, 1.0
            else:
                yield o, low, 1.0 - share
                yield o, low + 1, share


def register(spark: SparkSession) -> None:
    """Makes resize_weights(source size, target size) known to SQL: use it in a lateral join."""
    spark.udtf.register("resize_weights", F.udtf(ResizeWeights, returnType="o int, s int, k double"))
