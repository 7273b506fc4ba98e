"""Image metadata: the CSV reader, label filters and the one-hot matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import before_dot, first_word, second_word, without_suffix

#: Column of each label, in the parsed table and in the raw CSV.
COLUMN_OF = {"left": "orient", "right": "orient", "dorsal": "aspect", "palmar": "aspect", "0": "accessories", "1": "accessories", "male": "gender", "female": "gender"}
RAW_COLUMN_OF = {"dorsal": "aspectOfHand", "palmar": "aspectOfHand", "left": "aspectOfHand", "right": "aspectOfHand", "male": "gender", "female": "gender", "with accessories": "accessories", "without accessories": "accessories"}
#: Flag of each label on accessories in the raw CSV: the historical reading, in
#: which 0 selects "with". ``polarity="documented"`` takes 1 for "with".
FLAGS = {"historical": {"with accessories": 0, "without accessories": 1}, "documented": {"with accessories": 1, "without accessories": 0}}
#: The columns of the one-hot matrix: name, column, value.
ONE_HOT = (("left", "orient", "left"), ("right", "orient", "right"), ("dorsal", "aspect", "dorsal"), ("palmar", "aspect", "palmar"), ("accessories", "accessories", "1"), ("no_accessories", "accessories", "0"), ("male", "gender", "male"), ("female", "gender", "female"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def parsed(raw: DataFrame) -> DataFrame:
    """(subjectid, image_id, gender, aspect, orient, accessories), by position."""
    c = raw.columns
    return raw.select(
        F.col(f"`{c[0]}`").alias("subjectid"), before_dot(F.col(f"`{c[7]}`")).alias("image_id"), F.col(f"`{c[2]}`").alias("gender"),
        first_word(F.col(f"`{c[6]}`")).alias("aspect"), second_word(F.col(f"`{c[6]}`")).alias("orient"), F.col(f"`{c[4]}`").alias("accessories"),
    )


def unique_images(meta: DataFrame) -> DataFrame:
    """One row an image, so that joins do not fan out: the least row stays."""
    rest = [c for c in meta.columns if c != "image_id"]
    return meta.groupBy("image_id").agg(F.min(F.struct(*rest)).alias("r")).select(*(F.col("image_id") if c == "image_id" else F.col(f"r.{c}") for c in meta.columns))


def label_filter(label: str, equals: bool = False, polarity: str = "historical") -> Column:
    """Predicate on raw rows. By default a substring test, by which ``male`` also
    finds ``female``; ``equals`` compares words. An unknown label is an error."""
    label = label.lower()
    if label not in RAW_COLUMN_OF:
        raise ValueError(f"unknown label {label!r}: one of {', '.join(RAW_COLUMN_OF)}")
    column = F.col(RAW_COLUMN_OF[label])
    if label in FLAGS[polarity]:
        return column.cast("int") == FLAGS[polarity][label]
    return F.array_contains(F.split(column, " "), label) if equals else column.contains(label)


def images_with(raw: DataFrame, label: str, equals: bool = False, polarity: str = "historical") -> DataFrame:
    """(imageid) of the rows that a label selects."""
    return raw.where(label_filter(label, equals, polarity)).select(without_suffix(F.col("imageName")).alias("imageid"))


def with_label(meta: DataFrame, label: str) -> DataFrame:
    """Rows of the parsed table with a label."""
    if label not in COLUMN_OF:
        raise ValueError(f"unknown label {label!r}: one of {', '.join(COLUMN_OF)}")
    return meta.where(F.col(COLUMN_OF[label]) == label)


def one_hot(rows: DataFrame, spec=ONE_HOT, key: str = "imageid") -> DataFrame:
    """``key`` and a 0/1 column for each (name, column, value)."""
    return rows.select(key, *(F.when(F.col(column) == value, 1).otherwise(0).alias(name) for name, column, value in spec))


def save_metadata(meta: DataFrame, path: str) -> None:
    """Replace the metadata table as a whole: running it twice changes nothing."""
    unique_images(meta).write.mode("overwrite").parquet(path)
