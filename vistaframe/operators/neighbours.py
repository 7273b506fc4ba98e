"""Nearest vectors.

A single query is one broadcast row. A set of queries is dealt out in blocks of
bounded size; a task compares Arrow batches with a block as matrices and passes
on the best k it has seen for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors as V
from ..shipping import map_batches
from .linear import matrix_of

#: Queries in a block, and elements of a block of differences.
BLOCK, CELLS = 1024, 1 << 21


def with_norm(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Norms as a column, so that they are not computed for every comparison."""
    return rows.withColumn("norm", V.norm(F.col(vec)))


def _measure(name: str) -> tuple[Callable[[], Column], bool]:
    """(score of columns vec, q_vec, norm, q_norm; whether more is nearer)."""
    v, q = F.col("vec"), F.col("q_vec")
    return {
        "cosine": (lambda: V.cosine_distance(q, v, F.col("q_norm"), F.col("norm")), False),
        "cosine_similarity": (lambda: V.cosine_similarity(q, v, F.col("q_norm"), F.col("norm")), True),
        "manhattan": (lambda: V.manhattan(q, v), False),
        "euclidean": (lambda: V.euclidean(q, v), False),
        "l2": (lambda: V.l2_float(q, v), False),
    }[name]


def nearest(rows: DataFrame, query: DataFrame, measure: str = "cosine", k: int = 5, include_query: bool = False) -> DataFrame:
    """(imageid, score) of the k rows nearest to the one row of ``query``; ties by id.

    ``rows`` and ``query`` have imageid and vec. A query without rows finds nothing.
    """
    q = with_norm(query.limit(1)).select(F.col("imageid").alias("q_id"), F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
    score, more = _measure(measure)
    met = with_norm(rows).crossJoin(F.broadcast(q))
    if not include_query:
        met = met.where(F.col("imageid") != F.col("q_id"))
    # nulls last, and dropped after the cut: a filter before it would compute each score again
    order = F.col("score").desc_nulls_last() if more else F.col("score").asc_nulls_last()
    return met.select("imageid", score().alias("score")).orderBy(order, "imageid").limit(k).where(F.col("score").isNotNull())


def distances(x: np.ndarray, q: np.ndarray, measure: str) -> np.ndarray:
    """Scores of all rows of ``x`` (first axis) against all of ``q``; NaN where there is none."""
    if measure.startswith("cosine"):
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None])
        return s if measure == "cosine_similarity" else 1 - s
    if measure == "l2":
        x, q = (m.astype(np.float32).astype(float) for m in (x, q))
    out = np.empty((len(x), len(q)))
    step = max(1, CELLS // max(1, q.size))
    for at in range(0, len(x), step):  # differences, not products: equal vectors are at exactly 0
        d = x[at : at + step, None] - q[None]
        out[at : at + step] = np.abs(d).sum(2) if measure == "manhattan" else np.sqrt((d * d).sum(2))
    return out


def _best(ids: list, scores: np.ndarray, k: int) -> list[tuple]:
    """The k least (score, id); rows without a score are left out."""
    known = np.flatnonzero(~np.isnan(scores))
    if len(known) > k:
        known = known[scores[known] <= np.partition(scores[known], k - 1)[k - 1]]
    return sorted((float(scores[i]), ids[i]) for i in known)[:k]


def nearest_to_each(rows: DataFrame, queries: DataFrame, measure: str = "cosine", k: int = 5, block: int = BLOCK) -> DataFrame:
    """(q_id, rank, imageid, score): the k rows nearest to every query row, itself left out.

    Queries go out in blocks of about ``block`` rows, one pass over the rows each;
    a task compares Arrow batches with the block as matrices and gives out its
    best k for each query, so what is shuffled is k rows a query and task.
    """
    more = _measure(measure)[1]

    def kernel_of(q_ids: list, q: np.ndarray):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in q_ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, s = batch.column(0).to_pylist(), distances(matrix_of(batch.column(1)), q, measure)
                s = -s if more else s
                for j, q_id in enumerate(q_ids):
                    found = [x for x in _best(ids, s[:, j], k + 1) if x[1] != q_id]
                    best[j] = sorted(best[j] + found)[:k]
            lines = [(q_id, i, -s if more else s) for q_id, own in zip(q_ids, best, strict=True) for s, i in own]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in lines], to_arrow_schema(schema))

        return kernel

    schema = _pair_schema(rows, queries)
    out = _by_block(rows, queries, kernel_of, schema, block)
    order = Window.partitionBy("q_id").orderBy(F.col("score").desc() if more else F.col("score").asc(), "imageid")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "rank", "imageid", "score")


def all_scores(rows: DataFrame, queries: DataFrame, measure: str, block: int = BLOCK) -> DataFrame:
    """(q_id, imageid, score) for every query row and every row: for matrices, whose
    size is that product by definition."""

    def kernel_of(q_ids: list, q: np.ndarray):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = distances(matrix_of(batch.column(1)), q, measure)
                ids = batch.column(0)
                for j, q_id in enumerate(q_ids):
                    yield pa.RecordBatch.from_arrays([pa.array([q_id] * len(ids), arrow.field(0).type), ids, pa.array(s[:, j])], arrow.names)

        return kernel

    schema = _pair_schema(rows, queries)
    arrow = to_arrow_schema(schema)
    return _by_block(rows, queries, kernel_of, schema, block)


def _pair_schema(rows: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("q_id", queries.schema["imageid"].dataType), T.StructField("imageid", rows.schema["imageid"].dataType), T.StructField("score", T.DoubleType())])


def _by_block(rows: DataFrame, queries: DataFrame, kernel_of, schema: T.StructType, block: int) -> DataFrame:
    """The rows through a kernel for each block of queries (and each length of vectors in it)."""
    blocks = max(1, -(-queries.count() // block))
    plain = rows.select("imageid", V.doubles(F.col("vec")).alias("vec"))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("imageid"), F.lit(blocks)) == b).select("imageid", V.doubles(F.col("vec"))).collect()
        for size in sorted({len(v) for _, v in own if v}) or [0]:
            q_ids, q = [i for i, v in own if v and len(v) == size], np.array([v for _, v in own if v and len(v) == size], float)
            part = map_batches(plain.where(F.size("vec") == size), kernel_of(q_ids, q), schema)
            out = part if out is None else out.unionByName(part)
    return out


def with_query_first(found: DataFrame, query_id, score: float = 0.0) -> DataFrame:
    """A ranked list with the query itself at its head, as rank 0."""
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("score", "imageid")))  # of k rows
    kind = found.schema["imageid"].dataType
    head = found.sparkSession.range(1).select(F.lit(query_id).cast(kind).alias("imageid"), F.lit(score).alias("score"), F.lit(0).alias("rank"))
    return head.unionByName(ranked.select("imageid", "score", "rank"))
