"""Session and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Where images, features and models live, and how the session is made.

    No credentials: a JDBC source takes its options, secrets included, from the
    caller's ``jdbc`` mapping.
    """

    image_dir: str = "images"
    image_glob: str = "*.jpg"
    store: str = "warehouse/features"
    models: str = "warehouse/models"
    reports: str = "warehouse/reports"
    metadata_csv: str = "metadata.csv"
    jdbc: dict[str, str] = field(default_factory=dict)


def build_session(name: str = "vistaframe", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC; on a cluster leave
    ``master`` and ``shuffle_partitions`` to its own settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
