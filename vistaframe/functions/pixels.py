"""Colour conversions of 8-bit channels, rounded and saturated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5))).cast("int")


def luma(b: Column, g: Column, r: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def gray(b: Column, g: Column, r: Column) -> Column:
    return _byte(luma(b, g, r))


def yuv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    y = luma(b, g, r)
    return _byte(y), _byte(0.492 * (b - y) + 128), _byte(0.877 * (r - y) + 128)
