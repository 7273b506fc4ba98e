"""Names, labels and textual vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def before_dot(name: Column) -> Column:
    return F.get(F.split(name, r"\."), F.lit(0))


def without_suffix(name: Column, characters: int = 4) -> Column:
    """Without the last characters, an extension of three letters by default."""
    return F.substring(name, F.lit(1), F.greatest(F.length(name) - characters, F.lit(0)))


def first_word(text: Column) -> Column:
    return F.get(F.split(text, " "), F.lit(0))


def second_word(text: Column) -> Column:
    return F.get(F.split(text, " "), F.lit(1))


def label_key(label: str) -> str:
    """A label as part of a name."""
    return label.replace(" ", "_")


def image_path(directory: str, image_id: Column, pattern: str = "*.jpg") -> Column:
    return F.concat(F.lit(directory.rstrip("/") + "/"), image_id, F.lit(pattern.replace("*", "")))


def vector_from_text(text: Column) -> Column:
    """``[1.0, 2.0]``, ``{1.0, 2.0}`` or a list of lists (flattened) as an array of
    doubles. ``nan`` in any case is NaN; a text that is no list is null."""
    listed = F.regexp_replace(F.translate(text, "{}", "[]"), r"(?i)\bnan\b", "NaN")
    nested = F.from_json(listed, "array<array<double>>")
    return F.when(listed.rlike(r"^\s*\[\s*\["), F.flatten(nested)).otherwise(F.from_json(listed, "array<double>"))


def vector_to_text(v: Column) -> Column:
    """As a literal in braces, for export to a relational store."""
    return F.concat(F.lit("{"), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("}"))
