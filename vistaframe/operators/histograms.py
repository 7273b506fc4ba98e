"""Histograms of codes, values and visual words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

EPSILON = 1e-7


def code_histogram(rows: DataFrame, by: str, code: str, bins: int = 26, epsilon: float = EPSILON) -> DataFrame:
    """(by, vec): counts of the codes 0..bins-1, empty bins included, over their sum.

    One row a group: each bin is an aggregate of its own, so there is one shuffle
    of ``bins`` partial counts a group and task.
    """
    counts = rows.groupBy(by).agg(*(F.count_if(F.col(code) == b).alias(f"n{b}") for b in range(bins)))
    n = [F.col(f"n{b}").cast("double") for b in range(bins)]
    total = sum(n[1:], n[0]) + epsilon
    return counts.select(by, F.array(*(x / total for x in n)).alias("vec"))


def range_histogram(rows: DataFrame, values: Sequence[str], bins: int = 10) -> DataFrame:
    """(name, bin, n): equal-width bins over each column's range, the last closed.

    Ranges and counts are partial aggregates; the one row of ranges is broadcast.
    A column with a single value has it in the middle of a range of width 1.
    """
    ends = rows.agg(*(F.min(c).cast("double").alias(f"lo_{c}") for c in values), *(F.max(c).cast("double").alias(f"hi_{c}") for c in values))
    met = rows.select(*values).crossJoin(F.broadcast(ends))
    places = []
    for c in values:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
        places.append(F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias(c))
    placed = met.select(*places)
    counts = placed.agg(*(F.count_if(F.col(c) == b).alias(f"{c}_{b}") for c in values for b in range(bins)))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(b).alias("bin"), F.col(f"{c}_{b}").alias("n")) for c in values for b in range(bins)))
    return counts.select(F.inline(cells))


def nearest_words(descriptors: DataFrame, codebook: DataFrame) -> DataFrame:
    """Descriptors with the word (cluster) of the nearest centre, ties to the least.

    The codebook, a few hundred centres, is one broadcast row; the comparison
    stays within the descriptor's row.
    """
    book = codebook.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("book"))
    met = descriptors.crossJoin(F.broadcast(book))
    best = F.array_min(F.transform("book", lambda c: F.struct(V.euclidean(F.col("vec"), c["center"]).alias("d"), c["cluster"].alias("cluster"))))
    return met.select(*descriptors.columns, best["cluster"].alias("word"))


def word_histogram(words: DataFrame, k: int, normalization: str = "literal") -> DataFrame:
    """(imageid, vec): visual words of each image over ``0..k-1``.

    ``literal`` divides by descriptors times their dimension, so a histogram sums
    to 1/dimension; ``count`` divides by descriptors and sums to 1.
    """
    if normalization not in ("literal", "count"):
        raise ValueError(f"unknown normalization {normalization!r}")
    size = F.size("vec") if normalization == "literal" else F.lit(1)
    cells = words.groupBy("imageid", "word").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    by = cells.groupBy("imageid").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"), F.sum("size").alias("size"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0)) / F.col("size"))
    return by.select("imageid", dense.alias("vec"))
