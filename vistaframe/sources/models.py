"""Fitted models, kept by name: a file of arrays for each version, renamed into place."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import SparkSession

from ..functions.text import label_key
from ..storage import names_in, read_bytes, rename_once, write_bytes


def model_name(model: str, technique: str, label: str | None = None) -> str:
    """The name of a feature model's factors, as of its reduced vectors."""
    return "_".join([model, technique.lower(), *([label_key(label)] if label else [])])


class ModelStore:
    """Named sets of arrays in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, **arrays: np.ndarray) -> None:
        """Store a new version; the old ones stay."""
        data = io.BytesIO()
        np.savez(data, **arrays)
        aside = f"{self.path}/.aside-{uuid.uuid4().hex}"
        found = names_in(self.spark, f"{self.path}/{name}")
        number = int(found[-1]) + 1 if found else 0
        write_bytes(self.spark, aside, data.getvalue())
        if not rename_once(self.spark, aside, f"{self.path}/{name}/{number:012d}"):
            raise RuntimeError(f"another writer has stored {name}; save again")

    def load(self, name: str) -> dict[str, np.ndarray] | None:
        """The newest version, or None."""
        found = names_in(self.spark, f"{self.path}/{name}")
        if not found:
            return None
        with np.load(io.BytesIO(read_bytes(self.spark, f"{self.path}/{name}/{found[-1]}")), allow_pickle=False) as arrays:
            return {k: arrays[k] for k in arrays.files}
