"""Composite queries: ingestion, retrieval, latent semantics, subjects, labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import label_key
from ..operators import codebook, factor, histograms, neighbours, oneclass, ranking, subjects
from ..operators.extractors import gradients, textures
from ..operators.keypoints import keypoints
from ..operators.matching import ratio_similarity
from ..operators.moments import colour_moments
from ..session import EngineConfig
from ..sources import metadata
from ..sources.features import MODELS, FeatureStore, check
from ..sources.images import pixels, read_images
from ..sources.models import ModelStore, model_name
from ..sources.reports import score_line, write_json, write_lines
from ..storage import written


def extract(images: DataFrame, model: str) -> DataFrame:
    """(imageid, vec) of one feature model; of model ``s``, (imageid, pos, vec)."""
    check(model)
    return {"m": lambda: colour_moments(pixels(images)), "s": lambda: keypoints(images), "h": lambda: gradients(images), "l": lambda: textures(images)}[model]()


def ingest(spark: SparkSession, config: EngineConfig, models: tuple[str, ...] = MODELS) -> None:
    """Extract and upsert features of an image directory."""
    images, store = read_images(spark, config.image_dir, config.image_glob), FeatureStore(spark, config.store)
    for model in models:
        if model == "s":
            store.upsert_descriptors(extract(images, model))
        else:
            store.upsert(extract(images, model), model)


def load_metadata(spark: SparkSession, config: EngineConfig, path: str) -> None:
    metadata.save_metadata(metadata.parsed(metadata.read_raw(spark, config.metadata_csv)), path)


def similar_by_stored_model(store: FeatureStore, models: ModelStore, image, model: str, technique: str, label: str | None = None, k: int = 11) -> DataFrame:
    """The images most like one among stored reduced vectors, an image that is not
    there folded in by the stored basis (and, for model ``s``, the stored codebook)."""
    check(model, technique)
    kept = models.load(model_name(model, technique, label))
    if kept is None:
        raise ValueError(f"no model {model_name(model, technique, label)!r} is stored")
    reduced = store.load(model, technique, label)
    if model == "s":
        return similar_in_latent_space(reduced, image, None, kept["basis"], k, store.load_descriptors(), kept["codebook"])
    rows = store.load(model)
    if bool(kept["negated"]):
        rows = rows.withColumn("vec", V.exp_negated(F.col("vec")))
    return similar_in_latent_space(reduced, image, rows, kept["basis"], k)


def similar_images(rows: DataFrame, image, model: str = "m", k: int = 5, descriptors: DataFrame | None = None, ratio: float = 0.8) -> DataFrame:
    """(imageid, score): the k images most like one. Descriptor bags (model ``s``) by
    the ratio test, descending; other models by cosine distance, ascending."""
    if model == "s":
        own = descriptors.where(F.col("imageid") == image)
        found = ratio_similarity(descriptors.where(F.col("imageid") != image), own.select("pos", "vec"), ratio)
        return found.select("imageid", "score").orderBy(F.col("score").desc(), "imageid").limit(k)
    return neighbours.nearest(rows, rows.where(F.col("imageid") == image), "cosine", k)


def fetch_feature(store: FeatureStore, image: str, model: str, folder: str) -> DataFrame:
    """(imageid, vec) of one image, also written to a report; of model ``s`` its
    descriptors (imageid, pos, vec)."""
    check(model)
    found = store.load_descriptors().where(F.col("imageid") == image) if model == "s" else store.lookup(image, model)
    write_json(found, folder)
    return found


def similar_in_latent_space(reduced: DataFrame, image, features: DataFrame | None = None, basis: np.ndarray | None = None, k: int = 11, descriptors: DataFrame | None = None, book: np.ndarray | None = None) -> DataFrame:
    """(imageid, score): nearest by Euclidean distance among reduced vectors, the query
    included. An image that is not among them is folded in by the ``basis`` from its
    features or, with a codebook, from its descriptors."""
    own = reduced.where(F.col("imageid") == image)
    if basis is not None and own.limit(1).count() == 0:
        if book is not None:
            features = codebook.encode_by(descriptors.where(F.col("imageid") == image), book)
        own = factor.fold_in(features.where(F.col("imageid") == image), basis)
        reduced = reduced.unionByName(own)
    return neighbours.nearest(reduced, own, "euclidean", k, include_query=True)


@dataclass
class LatentSemantics:
    images: DataFrame  # (semantic, rank, imageid, weight)
    features: DataFrame  # (semantic, imageid, score)
    factors: factor.Factors


def latent_semantics(rows: DataFrame, technique: str, k: int, model: str = "m", label_ids: DataFrame | None = None, descriptors: DataFrame | None = None, negative: str = "exp", store: FeatureStore | None = None, label: str | None = None, words: int = codebook.WORDS, models: ModelStore | None = None) -> LatentSemantics:
    """Reduce a feature table to k latent semantics, rank images by them, store the
    reduced vectors (``store``) and the basis, scale and codebook (``models``).

    ``negative``: how the moments model is made non-negative before any technique:
    ``exp`` (1 / exp(x)) or ``none``. ``label_ids`` (imageid) restricts the images.
    """
    check(model, technique)
    technique, book = technique.lower(), None
    if model == "s":
        descriptors = descriptors.join(label_ids, "imageid", "left_semi") if label_ids is not None else descriptors
        book = np.array([c for c in codebook.learn_codebook(descriptors, words).clusterCenters()])
        rows = codebook.encode_by(descriptors, book)
    elif label_ids is not None:
        rows = rows.join(label_ids, "imageid", "left_semi")
    rows = rows.select("imageid", V.doubles(F.col("vec")).alias("vec"))
    if model == "m" and negative == "exp":
        rows = rows.withColumn("vec", V.exp_negated(F.col("vec")))
    rows = written(rows, "features")  # read by the fit and by each of the results
    found = factor.TECHNIQUES[technique](rows, k)
    images = ranking.ranked_loadings(found.ranking)
    best = ranking.best_for_each(rows, found.basis.tolist())
    if store is not None:
        store.upsert(found.reduced, model, technique, label_key(label) if label else None)
    if models is not None:
        more = {} if book is None else {"codebook": book}
        models.save(model_name(model, technique, label), basis=found.basis, scale=found.scale, negated=np.array(model == "m" and negative == "exp"), **more)
    return LatentSemantics(images, best, found)


def save_report(result: LatentSemantics, folder: str) -> None:
    write_lines(result.images.orderBy("semantic", "rank"), F.concat_ws(" ", "semantic", score_line(F.col("imageid"), F.col("weight"))), f"{folder}/images")
    write_lines(result.features.orderBy("semantic"), F.concat_ws(" ", "semantic", score_line(F.col("imageid"), F.col("score"))), f"{folder}/features")


def similar_subjects(rows: DataFrame, meta: DataFrame, k: int = 3) -> DataFrame:
    """(a, rank, b, sim) for every subject."""
    met = rows.join(metadata.unique_images(meta), rows["imageid"] == F.col("image_id")).select("subjectid", "vec")
    return subjects.most_similar(subjects.centroids(met), k)


def subject_semantics(matrix: DataFrame, k: int) -> DataFrame:
    """(semantic, rank, subject, weight): non-negative factors of the subject matrix."""
    lines = matrix.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "sim"))).alias("s"))
    rows = lines.select(F.col("a").cast("string").alias("imageid"), F.transform("s", lambda x: x["sim"]).alias("vec"))
    names = [r[0] for r in lines.select("a").orderBy("a").collect()]
    found = factor.nmf(rows, k)
    h = matrix.sparkSession.createDataFrame([(str(names[j]), [float(x) for x in found.basis[:, j]]) for j in range(len(names))], "subject string, vec array<double>")
    return ranking.ranked_loadings(h, "subject")


def metadata_semantics(onehot: DataFrame, k: int, names: list[str], key: str = "imageid") -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of the 0/1 matrix of images and metadata features:
    (semantic, rank, image, weight) and (semantic, rank, feature, weight).

    The matrix is factored with images as rows, so that it is never transposed;
    images are ranked by their weights, features by the basis.
    """
    rows = onehot.select(key, F.array(*(F.col(n).cast("double") for n in names)).alias("vec"))
    found = factor.nmf(rows, k, key)
    features = onehot.sparkSession.createDataFrame([(n, [float(x) for x in found.basis[:, j]]) for j, n in enumerate(names)], "feature string, vec array<double>")
    return ranking.ranked_loadings(found.ranking, key), ranking.ranked_loadings(features, "feature")


def classify_label(rows: DataFrame, meta: DataFrame, label: str, models: ModelStore | None = None) -> DataFrame:
    """(imageid, decision, inside) of all images by the one-class machine of a label,
    which is stored under ``models``."""
    ids = metadata.with_label(metadata.unique_images(meta), label).select(F.col("image_id").alias("imageid"))
    out, machine, basis = oneclass.classify(rows, rows.join(ids, "imageid", "left_semi"))
    if models is not None:
        models.save(f"one_class_{label_key(label)}", support=machine.support, alpha=machine.alpha, rho=np.array(machine.rho), gamma=np.array(machine.gamma), basis=basis)
    return out


def classify_by_stored(rows: DataFrame, models: ModelStore, label: str) -> DataFrame:
    """The same of any images by a stored machine."""
    kept = models.load(f"one_class_{label_key(label)}")
    if kept is None:
        raise ValueError(f"no machine of label {label!r} is stored")
    return oneclass.decided(rows, oneclass.OneClass(kept["support"], kept["alpha"], float(kept["rho"]), float(kept["gamma"])), kept["basis"])


def dataset_histograms(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(name, bin, n) of the means, deviations and skewnesses of the moments model."""
    nine = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.expr("size(vec) div 9") - 1), lambda w: F.slice("vec", w * 9 + 1, F.lit(9)))).alias("w"))
    parts = nine.select(F.explode(F.arrays_zip(F.slice("w", 1, 3).alias("mean"), F.slice("w", 4, 3).alias("sd"), F.slice("w", 7, 3).alias("skew"))).alias("x")).select("x.*")
    return histograms.range_histogram(parts, ["mean", "sd", "skew"], bins)
