"""Vector arithmetic as expressions over ARRAY<DOUBLE> columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - a.b / (|a||b|); pass the norms where they are columns already."""
    return 1 - dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def distance_similarity(distance: Column) -> Column:
    """1 / (1 + d), the similarity of word vectors at Euclidean distance d."""
    return 1 / (distance + 1)


def usable(a: Column) -> Column:
    """Neither null, empty, all zero, nor with a NaN or null."""
    sound = F.exists(a, lambda x: x != 0) & ~F.exists(a, lambda x: F.isnan(x) | x.isNull())
    return F.coalesce(sound, F.lit(False))


def hashed_embedding(text: Column, dims: int = 300, seed: int = 0) -> Column:
    """A vector of numbers from 0 to 1 that stands for no meaning: equal texts have equal vectors, on any machine."""
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), i, F.coalesce(text, F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296
    return F.transform(F.sequence(F.lit(1), F.lit(dims)), number)
