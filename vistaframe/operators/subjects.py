"""Subjects: groups of images with a common owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import written
from . import neighbours


def collected(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """(subjectid, images): the ids of each subject's images, ascending."""
    met = rows.join(meta, rows["imageid"] == meta["image_id"])
    return met.groupBy("subjectid").agg(F.sort_array(F.collect_list("imageid")).alias("images"))


def centroid_elements(rows: DataFrame, by: str = "subjectid", vec: str = "vec") -> DataFrame:
    """(by, pos, value): mean vectors in long form; only partial sums are shuffled."""
    return rows.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("value"))


def centroids(rows: DataFrame, by: str = "subjectid", vec: str = "vec") -> DataFrame:
    """(by, vec): the mean vector of each group."""
    parts = centroid_elements(rows, by, vec).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return parts.select(by, F.transform("p", lambda x: x["value"]).alias("vec"))


def _means(means: DataFrame, by: str) -> DataFrame:
    """Computed once: both sides of a comparison read it."""
    return written(means.select(F.col(by).alias("imageid"), "vec"), "means")


def similarity_matrix(means: DataFrame, by: str = "subjectid") -> DataFrame:
    """(a, b, sim) for all ordered pairs of subjects, themselves included."""
    rows = _means(means, by)
    return neighbours.all_scores(rows, rows, "l2").select(F.col("q_id").alias("a"), F.col("imageid").alias("b"), V.closeness(F.col("score")).alias("sim"))


def most_similar(means: DataFrame, k: int = 3, by: str = "subjectid") -> DataFrame:
    """(a, rank, b, sim): the k subjects most similar to each, itself left out. The
    matrix is never made: subjects are compared in blocks, and k a task are kept."""
    rows = _means(means, by)
    near = neighbours.nearest_to_each(rows, rows, "l2", k)
    return near.select(F.col("q_id").alias("a"), "rank", F.col("imageid").alias("b"), V.closeness(F.col("score")).alias("sim"))
