"""Image directories as DataFrames of images, pixels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import gray, yuv
from ..functions.text import file_stem

TILE = 100


def read_images(spark: SparkSession, directory: str, pattern: str = "*.jpg") -> DataFrame:
    """(image_id, height, width, channels, data) of images that can be decoded; the
    JVM decodes, channels are blue, green, red."""
    rows = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", "true").load(directory).select("image.*")
    return rows.select(file_stem(F.col("origin")).alias("image_id"), "height", "width", F.col("nChannels").alias("channels"), "data")


def count_images(spark: SparkSession, directory: str, pattern: str = "*.jpg") -> int:
    """Files that match, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path").count()


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, row, col, b, g, r): one row a pixel, within the JVM."""
    size = F.col("height") * F.col("width")
    value = lambda k: F.conv(F.hex(F.substring("data", F.col("at") * F.col("channels") + k + 1, F.lit(1))), 16, 10).cast("int")
    each = images.select("image_id", "width", "channels", "data", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    colour = lambda k: F.when(F.col("channels") >= 3, value(k)).otherwise(value(0))
    return each.select("image_id", F.expr("at div width").cast("int").alias("row"), (F.col("at") % F.col("width")).alias("col"), colour(0).alias("b"), colour(1).alias("g"), colour(2).alias("r"))


def with_yuv(px: DataFrame) -> DataFrame:
    y, u, v = yuv(F.col("b"), F.col("g"), F.col("r"))
    return px.select("image_id", "row", "col", y.alias("y"), u.alias("u"), v.alias("v"))


def with_gray(px: DataFrame) -> DataFrame:
    return px.select("image_id", "row", "col", gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))


def tile_of(row: Column, col: Column, tile: int = TILE) -> tuple[Column, Column]:
    return F.floor(row / tile).cast("int"), F.floor(col / tile).cast("int")


def synthetic_pixels(spark: SparkSession, height: int = 250, width: int = 130, images: int = 2) -> DataFrame:
    """A deterministic pixel grid; its edge tiles are partial."""
    n = height * width
    at = spark.range(n * images)
    rest = F.col("id") % n
    out = at.select((F.expr(f"id div {n}")).alias("image_id"), F.expr(f"(id % {n}) div {width}").alias("row"), (rest % width).alias("col"))
    i, r, c = F.col("image_id"), F.col("row"), F.col("col")
    return out.select("image_id", r.cast("int").alias("row"), c.cast("int").alias("col"), ((r * 3 + c * 5 + i * 11) % 256).cast("int").alias("b"), ((r * 7 + c * 2 + i * 29) % 256).cast("int").alias("g"), ((r * c + 13 * i) % 256).cast("int").alias("r"))
