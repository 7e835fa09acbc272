"""Standardisers: from a distance or a similarity to a similarity, as Column -> Column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse_capped(value: Column) -> Column:
    """min(1, 1 / value); 0 counts as infinitely similar, so it gives 1."""
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1.0), value), F.when(value == 0, F.lit(1.0))))


def cosine(distance: Column) -> Column:
    return (2 - distance) / 2


#: Up to this distance ``log1p`` gives 1.
LOG1P_LEVEL = math.e - 1


def log1p(distance: Column) -> Column:
    """1 up to a distance of e - 1, then 1 / ln(1 + distance)."""
    return F.when(distance <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 1 / F.log1p(F.greatest(distance, F.lit(1e-12)))))


def weighted(value: Column, weight: float = 0.1) -> Column:
    return value * weight


def bounded(value: Column, upper: float) -> Column:
    return value / upper


def random_bias(value: Column, rate: float = 0.0, seed: int = 0) -> Column:
    """Scaled by a random number between 1 - rate and 1."""
    return value if rate == 0 else value * (1 - F.lit(rate) * F.rand(seed))
