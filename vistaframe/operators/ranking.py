"""Rankings of images and features by latent semantic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import written


def loadings(rows: DataFrame, key: str = "imageid", weights: str = "vec") -> DataFrame:
    """(semantic, key, weight): one row for each weight; semantics count from 1."""
    return rows.select(F.posexplode(weights).alias("at", "weight"), key).select((F.col("at") + 1).alias("semantic"), key, "weight")


def ranked(rows: DataFrame, by: str, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """All rows with their ``rank`` (from 1) in each group, for groups of any size.

    A window by group alone would put a whole group in one task. Here rows are
    dealt by range over (group, order); ranks within a range are added to the
    sizes of the ranges before, which are few.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, F.col(by), *order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col(by).alias("__by"), F.col("__part").alias("__of"), before.alias("__before")))  # groups and ranges only
    within = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))
    met = dealt.withColumn("__within", within).join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__of")))
    return met.select(*rows.columns, (F.col("__within") + F.col("__before")).alias("rank"))


def ranked_loadings(rows: DataFrame, key: str = "imageid", weights: str = "vec") -> DataFrame:
    """(semantic, rank, key, weight): all items by weight, descending, ties by key."""
    return ranked(loadings(rows, key, weights), "semantic", [F.col("weight").desc(), F.col(key)]).select("semantic", "rank", key, "weight")


def top_loadings(rows: DataFrame, k: int = 5, key: str = "imageid", weights: str = "vec") -> DataFrame:
    """(semantic, rank, key, weight) of the k greatest; only k rows a task are shuffled."""
    order = Window.partitionBy("semantic").orderBy(F.col("weight").desc(), key)
    return loadings(rows, key, weights).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("semantic", "rank", key, "weight")


def best_for_each(rows: DataFrame, basis: Sequence[Sequence[float]], key: str = "imageid") -> DataFrame:
    """(semantic, key, score): the image with the greatest dot product with each basis vector, ties by key."""
    scores = rows.select(key, V.projected(F.col("vec"), basis).alias("s"))
    first = F.struct((-F.col("weight")).alias("least"), F.col(key).alias("of"))
    best = loadings(scores, key, "s").where("weight is not null").groupBy("semantic").agg(F.min(first).alias("first"))
    return best.select("semantic", F.col("first")["of"].alias(key), (-F.col("first")["least"]).alias("score"))
