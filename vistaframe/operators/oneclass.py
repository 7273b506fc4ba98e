"""One-class support vector machines for labels.

A label's machine is fitted on a bounded sample of its images (those of least
hash of the id, ``most_rows`` at most) in ten principal components; all images
are scored against the support vectors, which the bound keeps small enough to
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .factor import pca
from .linear import gram_sums, mapped

NU, GAMMA, DIMENSIONS, MOST_ROWS = 0.1, 0.1, 10, 2000


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


@dataclass
class OneClass:
    support: np.ndarray
    alpha: np.ndarray
    rho: float
    gamma: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Above 0 inside the class, below outside."""
        return rbf(x, self.support, self.gamma) @ self.alpha - self.rho


def fit_one_class(x: np.ndarray, nu: float = NU, gamma: float = GAMMA, tolerance: float = 1e-6, most_steps: int = 100_000) -> OneClass:
    """Minimise a'Ka/2 with 0 <= a <= 1/(nu n), sum a = 1, two weights at a time."""
    n = len(x)
    cap = 1 / (nu * n)
    a = np.zeros(n)
    full = int(nu * n)
    a[:full] = cap
    if full < n:
        a[full] = 1 - full * cap
    kernel = rbf(x, x, gamma)
    g = kernel @ a
    for _ in range(most_steps):
        up, down = np.where(a < cap - 1e-12, g, np.inf), np.where(a > 1e-12, g, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < tolerance:
            break
        step = (g[j] - g[i]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, cap - a[i], a[j])
        a[i] += step
        a[j] -= step
        g += step * (kernel[:, i] - kernel[:, j])
    free = (a > 1e-9) & (a < cap - 1e-9)
    rho = float(g[free].mean()) if free.any() else float((g[a > 1e-9].max() + g[a <= 1e-9].min(initial=g.max())) / 2)
    used = a > 1e-12
    return OneClass(x[used], a[used], rho, gamma)


def classify(rows: DataFrame, labelled: DataFrame, dimensions: int = DIMENSIONS, nu: float = NU, gamma: float = GAMMA, most_rows: int = MOST_ROWS) -> tuple[DataFrame, OneClass, np.ndarray]:
    """(imageid, decision, inside) for all ``rows`` by the class of ``labelled``, the machine and its components."""
    sample = labelled.orderBy(F.xxhash64("imageid"), "imageid").limit(most_rows).persist()
    factors = pca(sample, dimensions)
    basis = factors.basis
    fitted = np.array([r[0] for r in sample.select(V.projected(V.doubles(F.col("vec")), basis.tolist())).collect()], float)
    sample.unpersist()
    model = fit_one_class(fitted, nu, gamma)
    return decided(rows, model, basis), model, basis


def decided(rows: DataFrame, model: OneClass, basis: np.ndarray) -> DataFrame:
    """(imageid, decision, inside) of all rows."""
    scored = mapped(rows, lambda x: model.decision(x @ basis.T)[:, None])
    return scored.select("imageid", F.get("vec", F.lit(0)).alias("decision"), (F.get("vec", F.lit(0)) >= 0).alias("inside"))


def centroid_distances(rows: DataFrame, key: str = "imageid") -> DataFrame:
    """(key, distance) of every row from the mean of all."""
    mean = gram_sums(rows).mean.tolist()
    centre = F.array(*(F.lit(x) for x in mean))
    return rows.select(key, V.euclidean(V.doubles(F.col("vec")), centre).alias("distance"))
