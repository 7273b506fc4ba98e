"""Linear algebra over tables of vectors.

Each Arrow batch gives one partial sum of size d x d or d; only these meet. The
number of columns d is small beside the number of rows: what the driver holds
(a d x d matrix) does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..shipping import map_batches


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix. Vectors of unequal lengths, or with null
    elements, are an error: read as one run of numbers they would shift into others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null element")
    width = len(flat) // n if n else 0
    if width * n != len(flat) or n and (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("vectors of unequal lengths have no matrix")
    return flat.to_numpy(zero_copy_only=False).reshape(n, width)


class Sums(NamedTuple):
    n: int
    mean: np.ndarray
    gram: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """With n - 1 below the line."""
        return (self.gram - self.n * np.outer(self.mean, self.mean)) / max(1, self.n - 1)


def gram_sums(rows: DataFrame, vec: str = "vec") -> Sums:
    """Row count, mean vector and the matrix of products of columns."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(0))
            n += len(x)
            total = x.sum(0) if total is None else total + x.sum(0)
            gram = x.T @ x if gram is None else gram + x.T @ x
        if n:
            d = len(total)
            lines = pa.array([[float(n)], total.tolist(), *gram.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 2), pa.int64()), pa.array(np.arange(d + 2), pa.int64()), lines], ["d", "line", "x"])

    parts = map_batches(rows.select(V.doubles(F.col(vec)).alias("vec")).where(F.col("vec").isNotNull()), kernel, "d long, line long, x array<double>")
    lines = parts.select("d", "line", F.posexplode("x").alias("pos", "x")).groupBy("d", "line", "pos").agg(F.sum("x").alias("x")).collect()
    if not lines:
        return Sums(0, np.zeros(0), np.zeros((0, 0)))
    if len({r["d"] for r in lines}) > 1:
        raise ValueError("vectors of unequal lengths have no matrix")
    d = lines[0]["d"]
    n, mean, gram = 0, np.zeros(d), np.zeros((d, d))
    for _, line, pos, x in lines:
        if line == 0:
            n = round(x)
        elif line == 1:
            mean[pos] = x
        else:
            gram[line - 2, pos] = x
    return Sums(n, mean / n, gram)


def matrix_rows(spark, matrix: np.ndarray) -> DataFrame:
    """(i, j, value) of a small matrix."""
    i, j = np.indices(matrix.shape)
    return spark.createDataFrame(list(zip(i.ravel().tolist(), j.ravel().tolist(), matrix.ravel().tolist(), strict=True)), "i long, j long, value double")


def mapped(rows: DataFrame, function, keep: str = "imageid", vec: str = "vec", out: str = "vec") -> DataFrame:
    """(keep, out): ``function`` (matrix to matrix, row by row) over Arrow batches."""
    schema = rows.select(keep).schema.add(out, T.ArrayType(T.DoubleType()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(function(matrix_of(batch.column(1))), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1] or 1), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [keep, out])

    return map_batches(rows.select(keep, V.doubles(F.col(vec)).alias("vec")).where(F.col("vec").isNotNull()), kernel, schema)


def standard_scale(rows: DataFrame, vec: str = "vec", key: str = "imageid") -> DataFrame:
    """Divide each column by its population deviation, without centring; constant columns stay as they are."""
    sums = gram_sums(rows, vec)
    if not sums.n:
        return rows.select(key, V.doubles(F.col(vec)).alias("vec"))
    variance = np.maximum(np.diag(sums.gram) / sums.n - sums.mean**2, 0)
    tiny = variance <= 1e-15 * np.maximum(sums.mean**2, 1e-300)
    deviation = np.where(tiny, 1.0, np.sqrt(variance))
    return mapped(rows, lambda x: x / deviation, key, vec)
