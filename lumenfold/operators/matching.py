"""Ordered lists of short patterns, files' paths, and intervals that rows fall into."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], how: str, default: str = "") -> Column:
    """The outcome of the first rule of the list that the text starts with, ends with, contains or equals (how).

    Rules are literals of the plan, so this needs no join; a null text has the default.
    """
    met = {"prefix": Column.startswith, "suffix": Column.endswith, "contains": Column.contains, "equal": Column.__eq__}[how]
    return F.coalesce(*[F.when(met(text, F.lit(word)), F.lit(out)) for word, out in rules], F.lit(default))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression of the whole text; * and ? also match a slash."""
    return "^(?s:" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + ")$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether the path or its last part fits one of the globs."""
    last = F.substring_index(path, "/", -1)
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g)) | last.rlike(glob_pattern(g))
    return out


def path_parts(path: Column) -> dict[str, Column]:
    """folder, name and extension (lower case, with its dot; empty if none)."""
    name = F.substring_index(path, "/", -1)
    return {
        "folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
        "name": name,
        "ext": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)),
    }


def binned_within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the spans of the same key that hold them (start <= at <= end), all of them numbers.

    A span is dealt to each bin of `width` that it touches, so the join is by equality on key and bin and only
    neighbours are compared; each pair comes once, as a point lies in one bin.
    """
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    left = points.withColumn("__bin", F.floor(F.col(at) / width))
    right = spans.filter(F.col(start) <= F.col(end)).withColumn("__bin", bins)
    return left.join(right, [key, "__bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__bin")
