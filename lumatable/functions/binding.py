"""Evaluate an expression once where a lambda would evaluate it per element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
