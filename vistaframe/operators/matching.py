"""Similarity of descriptor bags by the ratio test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..shipping import map_batches
from .linear import matrix_of
from .neighbours import distances

RATIO = 0.8


def _two_nearest(q: np.ndarray):
    """Batches of (imageid, vec), to the two least distances of each query descriptor in each image of a batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode()
            at, d = code.indices.to_numpy(zero_copy_only=False), distances(matrix_of(batch.column(1)), q, "l2")
            images, places, least = [], [], []
            for image in range(len(code.dictionary)):
                two = np.sort(d[at == image], axis=0)[:2]
                images.append(np.full(two.size, image))
                places.append(np.tile(np.arange(len(q)), len(two)))
                least.append(two.ravel())
            images = code.dictionary.take(pa.array(np.concatenate(images)))
            yield pa.RecordBatch.from_arrays([images, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(least))], ["imageid", "q_pos", "d"])

    return kernel


def ratio_similarity(descriptors: DataFrame, query: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(imageid, good, n, score): share of the query image's descriptors whose nearest
    neighbour in an image is closer than ``ratio`` times the second nearest.

    ``descriptors``: (imageid, pos, vec) of all images; ``query``: (pos, vec) of one
    image, and so of one image's size. A task compares Arrow batches with it and
    gives out the two nearest of each descriptor and image; these meet in a window
    that keeps two. Fewer than two neighbours make no good match.
    """
    q = np.array([v for (v,) in query.orderBy("pos").select(V.doubles(F.col("vec"))).collect()], float)
    if not len(q):
        return descriptors.select("imageid", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score")).limit(0)
    plain = descriptors.select("imageid", V.doubles(F.col("vec")).alias("vec")).where(F.size("vec") == q.shape[1])
    schema = plain.select("imageid").schema.add("q_pos", T.IntegerType()).add("d", T.DoubleType())
    met = map_batches(plain, _two_nearest(q), schema)
    order = Window.partitionBy("imageid", "q_pos").orderBy("d")
    two = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2)
    pair = two.groupBy("imageid", "q_pos").agg(F.max(F.when(F.col("place") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("place") == 2, F.col("d"))).alias("d2"))
    good = F.count_if(F.coalesce(F.col("d1") < ratio * F.col("d2"), F.lit(False)))
    return pair.groupBy("imageid").agg(good.alias("good"), F.count("*").alias("n")).select("imageid", "good", "n", (F.col("good") / F.col("n")).alias("score"))
