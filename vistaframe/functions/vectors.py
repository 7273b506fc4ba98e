"""Vector arithmetic over array columns.

Vectors of unequal length give null: pairing them up would pad or cut silently.
A division by a zero norm is null as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _paired(a: Column, b: Column, body) -> Column:
    return F.when(F.size(a) == F.size(b), _fold(F.zip_with(a, b, body)))


def total(v: Column) -> Column:
    return _fold(v)


def dot(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(v, lambda x: x * x)))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Pass norms that are at hand as columns; they are not computed again."""
    return F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return 1 - cosine_similarity(a, b, norm_a, norm_b)


def manhattan(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def l2_float(a: Column, b: Column) -> Column:
    """Euclidean distance of the vectors as single-precision numbers, summed in double."""
    single = lambda v: v.cast("array<float>").cast("array<double>")
    return euclidean(single(a), single(b))


def closeness(distance: Column) -> Column:
    """A similarity in (0, 1] from a distance."""
    return 1 / (1 + distance)


def exp_negated(v: Column) -> Column:
    """exp(-x) by element: positive for any sign, 0 or infinity at the far ends."""
    return F.transform(v, lambda x: F.exp(-x))


def divided(v: Column, by: Column) -> Column:
    """Element by element; a zero divisor gives null."""
    return F.zip_with(v, by, lambda x, s: F.try_divide(x, s))


def projected(v: Column, basis: Sequence[Sequence[float]]) -> Column:
    """Dot products with the rows of a small fixed basis."""
    return F.array(*(dot(v, F.array(*(F.lit(float(x)) for x in row))) for row in basis))
