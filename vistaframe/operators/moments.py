"""Statistics of windows of pixels or values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import TILE, tile_of, with_yuv


def window_moments(rows: DataFrame, by: Sequence[Column | str], channels: Sequence[str]) -> DataFrame:
    """Mean, population deviation and population skewness of each channel by window;
    the skewness of a constant window is 0. One pass, partial sums only."""
    aggregates = []
    for c in channels:
        # nearly constant: the deviation is below what rounding leaves of the values
        constant = F.stddev_pop(c) <= 1e-9 * F.greatest(F.abs(F.avg(c)), F.lit(1e-300))
        aggregates += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}"), F.when(constant, 0.0).otherwise(F.coalesce(F.skewness(c), F.lit(0.0))).alias(f"skew_{c}")]
    return rows.groupBy(*by).agg(*aggregates)


def colour_moments(px: DataFrame, tile: int = TILE) -> DataFrame:
    """(imageid, vec): nine moments a tile, tiles in row-major order, edge tiles partial."""
    rows = with_yuv(px)
    r, c = tile_of(F.col("row"), F.col("col"), tile)
    m = window_moments(rows.select("image_id", r.alias("tr"), c.alias("tc"), "y", "u", "v"), ["image_id", "tr", "tc"], ["y", "u", "v"])
    nine = F.array(*(F.col(f"{k}_{x}") for k in ("mean", "sd", "skew") for x in ("y", "u", "v")))
    tiles = m.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("tr", "tc", nine.alias("nine")))).alias("t"))
    return tiles.select(F.col("image_id").cast("string").alias("imageid"), F.flatten(F.transform("t", lambda x: x["nine"])).alias("vec"))


def block_means(px: DataFrame, value: str, block: int = 10) -> DataFrame:
    """(image_id, br, bc, mean): means of whole blocks; what an edge block lacks counts as 0."""
    r, c = tile_of(F.col("row"), F.col("col"), block)
    return px.groupBy("image_id", r.alias("br"), c.alias("bc")).agg((F.sum(value) / (block * block)).alias("mean"))
