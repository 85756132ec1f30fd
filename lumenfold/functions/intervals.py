"""Closed intervals of whole numbers as structs (lo, hi); hi is null where there is no upper bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def added(a: Column, b: Column) -> Column:
    return interval(a["lo"] + b["lo"], a["hi"] + b["hi"])


def multiplied(a: Column, b: Column) -> Column:
    """Of intervals that begin at 0 or above: the products of their ends; no upper bound where one has none, but for a
    factor that is 0."""
    zero = (a["hi"] == 0) | (b["hi"] == 0)
    return interval(a["lo"] * b["lo"], F.when(zero, F.lit(0)).otherwise(a["hi"] * b["hi"]))


def joined(a: Column, b: Column) -> Column:
    """The least interval that holds both."""
    return interval(F.least(a["lo"], b["lo"]), F.when(a["hi"].isNotNull() & b["hi"].isNotNull(), F.greatest(a["hi"], b["hi"])))


def met(a: Column, b: Column) -> Column:
    """What both hold; lo > hi where that is nothing."""
    return interval(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def can_exceed(a: Column, limit: Column) -> Column:
    return a["hi"].isNull() | (a["hi"] > limit)
