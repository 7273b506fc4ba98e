"""Visual words: a k-means codebook over descriptors and histograms over it."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .histograms import nearest_words, word_histogram

WORDS = 300


def words_for(n: int, words: int = WORDS) -> int:
    """The number of words: half the descriptors if these are fewer than the usual number."""
    return n // 2 if n < words else words


def _features(descriptors: DataFrame) -> DataFrame:
    return descriptors.withColumn("features", array_to_vector(V.doubles(F.col("vec"))))


def learn_codebook(descriptors: DataFrame, words: int = WORDS, seed: int = 0, rounds: int = 20) -> KMeansModel:
    k = max(2, words_for(descriptors.count(), words))
    rows = _features(descriptors).select("features").persist()
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(rows)
    rows.unpersist()
    return model


def centres(model: KMeansModel, spark) -> DataFrame:
    """(cluster, center) of a model."""
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")


def encode_by(descriptors: DataFrame, book: np.ndarray, normalization: str = "literal") -> DataFrame:
    """The same from the centres alone (one in a line), such as those of a stored codebook."""
    table = descriptors.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(book)], "cluster int, center array<double>")
    return word_histogram(nearest_words(descriptors.select("imageid", V.doubles(F.col("vec")).alias("vec")), table), len(book), normalization)


def encode(descriptors: DataFrame, model: KMeansModel, normalization: str = "literal") -> DataFrame:
    """(imageid, vec): histograms of visual words, all descriptors at once."""
    words = model.transform(_features(descriptors)).select("imageid", "vec", F.col("prediction").alias("word"))
    return word_histogram(words, len(model.clusterCenters()), normalization)
