"""Python kernels on executors that have no copy of this package.

A kernel is pickled by reference, so its module must be importable where it
runs. The package, a few files, is zipped once a Spark application and handed
to the executors by Spark itself.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on all executors, present and to come."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vistaframe-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _done.add(context.applicationId)


class Tidy:
    """A kernel that hands memory back to the system when it ends. A Python worker serves
    many tasks, and what allocators keep for it counts against its executor."""

    def __init__(self, kernel):
        self.kernel = kernel

    def __call__(self, batches):
        try:
            yield from self.kernel(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
                ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(rows: DataFrame, kernel, schema) -> DataFrame:
    """``mapInArrow`` with a kernel of this package."""
    ship(rows.sparkSession)
    return rows.mapInArrow(Tidy(kernel), schema)
