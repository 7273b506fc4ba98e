"""The feature store: one partitioned table in place of a table for each name.

``features(model, technique, label, k, imageid, vec)`` lies in folders by
model, technique and label; a scan of one of them prunes the rest. Rows of a
folder are dealt to buckets by a hash of imageid. An upsert writes new versions
of the buckets it touches beside the old ones, then renames into place a file
that names the version of every bucket, so readers see the old rows or the new,
never half of them, and a crash on the way changes nothing. A lookup reads one
bucket. ``vacuum`` removes versions that no longer count.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_key, vector_from_text, vector_to_text
from ..storage import delete, discard, names_in, read_bytes, rename_once, write_bytes, written

MODELS = ("m", "s", "h", "l")
TECHNIQUES = ("pca", "svd", "nmf", "lda")
NONE = "-"
SCHEMA = "imageid string, vec array<double>"
BAG_SCHEMA = "imageid string, pos int, vec array<double>"
#: Of a folder that is new; a folder keeps the number it began with.
BUCKETS = 16


def check(model: str, technique: str | None = None) -> None:
    """Refuse an unknown model or technique before any work is done."""
    if model not in MODELS:
        raise ValueError(f"unknown feature model {model!r}: one of {', '.join(MODELS)}")
    if technique is not None and technique.lower() not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique!r}: one of {', '.join(TECHNIQUES)}")


def upserted(old: DataFrame, new: DataFrame, key: str = "imageid") -> DataFrame:
    """New rows, and those of the old whose key is not among them. One shuffle by key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


class FeatureStore:
    """``buckets``: into how many parts a new folder's rows are dealt. An upsert rewrites
    the parts it touches, so choose it by the table's size (a part of 1 GB, say)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folder(self, model: str, technique: str | None, label: str | None) -> str:
        check(model, technique)
        return f"{self.path}/model={model}/technique={(technique or NONE).lower()}/label={label_key(label) if label else NONE}"

    def _current(self, folder: str) -> tuple[int, int, dict[int, str]]:
        """(number of the newest pointer or -1, number of buckets, version of each bucket)."""
        found = [n for n in names_in(self.spark, folder) if n.startswith("current-")]
        if not found:
            return -1, self.buckets, {}
        told = json.loads(read_bytes(self.spark, f"{folder}/{found[-1]}"))
        return int(found[-1].removeprefix("current-")), told["buckets"], {int(b): v for b, v in told["versions"].items()}

    def _read(self, folder: str, schema: str, versions: dict[int, str], only: list[int] | None = None) -> DataFrame:
        paths = [f"{folder}/{v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("imageid"), F.lit(buckets)).cast("int")

    def _replace(self, folder: str, schema: str, new: DataFrame) -> None:
        """Put ``new`` in place of all rows of its imageids."""
        number, buckets, versions = self._current(folder)
        new = written(new, "upsert")
        touched = [r[0] for r in new.select(self._bucket(buckets)).distinct().collect()]
        if touched:
            ids = new.select("imageid").distinct()
            old = self._read(folder, schema, versions, touched).join(ids, "imageid", "left_anti")
            rows = new.unionByName(old).withColumn("bucket", self._bucket(buckets))
            version = f"v-{uuid.uuid4().hex}"
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/{version}")
            told = json.dumps({"buckets": buckets, "versions": versions | dict.fromkeys(touched, version)})
            write_bytes(self.spark, f"{folder}/.{version}", told.encode())
            if not rename_once(self.spark, f"{folder}/.{version}", f"{folder}/current-{number + 1:012d}"):
                delete(self.spark, f"{folder}/{version}")
                raise RuntimeError(f"another writer has changed {folder}; upsert again")
        discard(new)

    def load(self, model: str, technique: str | None = None, label: str | None = None) -> DataFrame:
        """(imageid, vec); no rows if nothing was stored."""
        folder = self._folder(model, technique, label)
        return self._read(folder, SCHEMA, self._current(folder)[2])

    def upsert(self, rows: DataFrame, model: str, technique: str | None = None, label: str | None = None) -> None:
        """Insert or replace by imageid; of rows with one imageid the least vector stays."""
        new = rows.select(F.col("imageid").cast("string"), F.col("vec").cast("array<double>")).groupBy("imageid").agg(F.min("vec").alias("vec"))
        self._replace(self._folder(model, technique, label), SCHEMA, new)

    def _bags(self) -> str:
        return f"{self._folder('s', None, None)}/bags"

    def load_descriptors(self) -> DataFrame:
        """(imageid, pos, vec) of the descriptor bags, model ``s``."""
        return self._read(self._bags(), BAG_SCHEMA, self._current(self._bags())[2])

    def upsert_descriptors(self, rows: DataFrame) -> None:
        """Insert or replace whole bags by imageid."""
        self._replace(self._bags(), BAG_SCHEMA, rows.select(F.col("imageid").cast("string"), F.col("pos").cast("int"), F.col("vec").cast("array<double>")))

    def vacuum(self, model: str, technique: str | None = None, label: str | None = None) -> None:
        """Remove versions and pointers that the newest pointer has replaced. Not while
        others read older ones or write."""
        own = self._folder(model, technique, label)
        for folder in (own, f"{own}/bags"):
            number, _, versions = self._current(folder)
            stays = {*versions.values(), f"current-{number:012d}"}
            for name in names_in(self.spark, folder):
                if name.startswith(("v-", ".v-", "current-")) and name not in stays:
                    delete(self.spark, f"{folder}/{name}")

    def lookup(self, imageid: str, model: str, technique: str | None = None, label: str | None = None) -> DataFrame:
        """The row of one image, from the one bucket that can hold it."""
        folder = self._folder(model, technique, label)
        _, buckets, versions = self._current(folder)
        one = self.spark.range(1).select(F.lit(imageid).cast("string").alias("imageid"))
        return self._read(folder, SCHEMA, versions, [one.select(self._bucket(buckets)).first()[0]]).where(F.col("imageid") == imageid)

    def known(self, ids: DataFrame, model: str, **which) -> DataFrame:
        return ids.join(self.load(model, **which).select("imageid"), "imageid", "left_semi")

    def unknown(self, ids: DataFrame, model: str, **which) -> DataFrame:
        return ids.join(self.load(model, **which).select("imageid"), "imageid", "left_anti")


def read_jdbc(spark: SparkSession, table: str, options: dict[str, str]) -> DataFrame:
    """A relational feature table (imageid, textual imagedata) as typed rows.

    Needs the database's JDBC driver on the class path. Pass partitionColumn,
    lowerBound, upperBound and numPartitions to read in parallel.
    """
    rows = spark.read.format("jdbc").options(dbtable=table, **options).load()
    return rows.select("imageid", vector_from_text(F.col("imagedata")).alias("vec"))


def write_jdbc(rows: DataFrame, table: str, options: dict[str, str], mode: str = "append") -> None:
    rows.select("imageid", vector_to_text(F.col("vec")).alias("imagedata")).write.format("jdbc").options(dbtable=table, **options).mode(mode).save()


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Catalogue tables for features and metadata. Parquet knows no primary key;
    uniqueness is the upsert's."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.features (imageid STRING NOT NULL, vec ARRAY<DOUBLE>, model STRING, technique STRING, label STRING) USING parquet PARTITIONED BY (model, technique, label)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.img_meta (subjectid STRING, image_id STRING, gender STRING, aspect STRING, orient STRING, accessories STRING) USING parquet")


def legacy_vectors(rows: DataFrame, data: str = "image_data") -> DataFrame:
    """Rows with a two-dimensional text array as typed, flat vectors."""
    return rows.select("imageid", F.flatten(F.col(data).cast("array<array<double>>")).alias("vec"))
