"""Scalar expressions that have no built-in name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def cyclic(x, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle."""
    angle = _c(x) * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def entropy(shares) -> Column:
    """Entropy in bits of an array of shares; zero shares count nothing."""
    return F.aggregate(_c(shares), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a, b, weights: list[float] | None = None) -> Column:
    square = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    if weights:
        square = F.zip_with(square, F.array(*map(F.lit, weights)), lambda d, w: d * w)
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def jaccard(a, b) -> Column:
    """Shared over all distinct elements of two arrays; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def argmax(a) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1


def words(text) -> Column:
    """Unicode words of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("(?U)\\w+"), 0)


def safe_divide(a, b, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(_c(a), _c(b)), F.lit(default))
