"""Text sinks: ranked lists and vectors as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_line(item: Column, score: Column) -> Column:
    return F.concat_ws(": ", item.cast("string"), score.cast("string"))


def write_lines(rows: DataFrame, line: Column, path: str, files: int = 1) -> None:
    """One text file by default; reports are short."""
    rows.select(line.alias("value")).coalesce(files).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
