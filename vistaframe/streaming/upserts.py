"""The upsert as a stream: new image files become features as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.features import SCHEMA, FeatureStore


def feature_stream(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows (imageid, vec) from Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def upsert_stream(rows: DataFrame, store: FeatureStore, model: str, checkpoint: str, technique: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upsert each micro-batch. A batch that is run again after a failure upserts the
    same rows, so the outcome is the same."""

    def apply(batch: DataFrame, number: int) -> None:
        store.upsert(batch, model, technique)

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
