"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the quality and fingerprint operators: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"
#: Letters, digits and everything beyond ASCII, after lower-casing A-Z.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A table of a few small files is dealt out anew: a file's only row group is one task, whatever the cores.
SMALL_MB = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path, so any store works."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages") and len(rows.inputFiles()) < cores(spark):
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= SMALL_MB * 1e6:
            return rows.repartition(cores(spark))
    return rows


def column(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = SPACES) -> Column:
    """The non-empty runs between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quiet_threads() -> None:
    """One core per task: native thread pools of libraries stay off."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
