"""Latent semantics: PCA, SVD, NMF and LDA.

All return a ``Factors``: k basis vectors (k x d, held by the driver) and
DataFrames of row weights. PCA and SVD come from d x d matrices summed in one
pass; signs are fixed by making each basis vector's greatest element positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shipping import map_batches
from .linear import gram_sums, mapped, matrix_of, standard_scale


@dataclass
class Factors:
    """``reduced``: (imageid, vec) to store; ``ranking``: weights to rank images by;
    ``basis``: k x d; ``scale``: eigenvalues, singular values or losses."""

    reduced: DataFrame
    ranking: DataFrame
    basis: np.ndarray
    scale: np.ndarray


def _signed(v: np.ndarray) -> np.ndarray:
    """Rows with their element of greatest magnitude positive."""
    at = np.abs(v).argmax(1)
    return v * np.where(v[np.arange(len(v)), at] < 0, -1.0, 1.0)[:, None]


def _top(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0), _signed(vectors[:, order].T)


def _inverse(x: np.ndarray) -> np.ndarray:
    return np.where(x > 1e-12 * max(x.max(initial=0), 1e-300), 1 / np.where(x > 0, x, 1), 0)


def pca(rows: DataFrame, k: int, key: str = "imageid") -> Factors:
    """Scores of centred rows; rankings use scores over eigenvalues."""
    sums = gram_sums(rows)
    values, basis = _top(sums.covariance, k)
    mean, inverse = sums.mean, _inverse(values)
    return Factors(mapped(rows, lambda x: (x - mean) @ basis.T, key), mapped(rows, lambda x: (x - mean) @ basis.T * inverse, key), basis, values)


def svd(rows: DataFrame, k: int, key: str = "imageid") -> Factors:
    """Scores of rows as they are; rankings use the left singular vectors."""
    values, basis = _top(gram_sums(rows).gram, k)
    singular = np.sqrt(values)
    inverse = _inverse(singular)
    return Factors(mapped(rows, lambda x: x @ basis.T, key), mapped(rows, lambda x: x @ basis.T * inverse, key), basis, singular)


def _weights(x: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative row weights for a fixed basis, by multiplicative steps from an even start."""
    cross, gram = np.maximum(x @ h.T, 0), h @ h.T
    w = np.full((len(x), len(h)), max(1e-12, float(np.sqrt(max(x.mean(), 1e-12) / len(h)))))
    for _ in range(steps):
        w *= cross / np.maximum(w @ gram, 1e-12)
    return w


def nmf(rows: DataFrame, k: int, key: str = "imageid", rounds: int = 30, steps: int = 60, seed: int = 0) -> Factors:
    """Non-negative factors of scaled rows.

    Row weights are a function of the row and the basis, so no state is kept with
    the rows and a lost task is simply run again. A round is one pass that sums
    two small matrices; the basis takes multiplicative steps on the driver.
    Stored are unscaled rows times the basis; rankings use the weights.
    """
    scaled = standard_scale(rows, key=key).persist()
    first = gram_sums(scaled)
    d = len(first.mean)
    h = np.abs(np.random.default_rng(seed).standard_normal((k, d))) * np.sqrt(max(first.mean.mean() if d else 0, 1e-12) / k)
    square, losses = float(np.trace(first.gram)), []

    def sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + d))
            for batch in batches:
                if batch.num_rows:
                    x = matrix_of(batch.column(0))
                    w = _weights(x, h, steps)
                    total += np.hstack([w.T @ w, w.T @ x])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["line", "x"])

        lines = map_batches(scaled.select("vec"), kernel, "line long, x array<double>").select("line", F.posexplode("x").alias("pos", "x")).groupBy("line", "pos").agg(F.sum("x").alias("x")).collect()
        out = np.zeros((k, k + d))
        for line, pos, x in lines:
            out[line, pos] = x
        return out[:, :k], out[:, k:]

    for _ in range(rounds):
        ww, wx = sums(h)
        losses.append(square - 2 * float((wx * h).sum()) + float((ww * (h @ h.T)).sum()))
        if len(losses) > 1 and losses[-2] - losses[-1] < 1e-5 * max(square, 1e-12):
            break
        for _ in range(10):
            h = h * wx / np.maximum(ww @ h, 1e-12)
    basis = h
    scaled.unpersist()
    return Factors(mapped(rows, lambda x: x @ basis.T, key), mapped(scaled, lambda x: _weights(x, basis, steps), key), basis, np.array(losses))


def lda(rows: DataFrame, k: int, key: str = "imageid", seed: int = 0, rounds: int = 20) -> Factors:
    """Topics of scaled, non-negative rows; stored are unscaled rows times the topics."""
    scaled = standard_scale(rows, key=key).select(key, array_to_vector("vec").alias("features"))
    model = LDA(k=k, seed=seed, maxIter=rounds).fit(scaled)
    basis = model.topicsMatrix().toArray().T
    ranking = model.transform(scaled).select(key, vector_to_array("topicDistribution").alias("vec"))
    return Factors(mapped(rows, lambda x: x @ basis.T, key), ranking, basis, np.array([model.logLikelihood(scaled)]))


TECHNIQUES = {"pca": pca, "svd": svd, "nmf": nmf, "lda": lda}


def fold_in(rows: DataFrame, basis: np.ndarray, key: str = "imageid") -> DataFrame:
    """Vectors that were not in the fit, as dot products with the basis (of PCA too,
    uncentred, as the behaviour matched has it)."""
    return rows.select(key, V.projected(V.doubles(F.col("vec")), basis.tolist()).alias("vec"))
