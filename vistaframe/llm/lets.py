"""Local bindings inside Column expressions.

A lambda of a higher-order function sees outer expressions by value only if
they are columns; an inlined expression would be evaluated again for every
element. ``let`` binds the value to a lambda variable, once per row, whatever
the optimizer does with the projections around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n-1 as an array; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def covered(starts: Column, length: int) -> Column:
    """Positions that intervals [start, start + length) cover; starts ascending, distinct."""
    return let(
        starts,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(length), F.coalesce(F.get(p, i + 1) - x, F.lit(length)))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )
