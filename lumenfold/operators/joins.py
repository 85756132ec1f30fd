"""Joins of tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by equal columns whose sides are both sorted. Rows that a generator makes count for nothing in the planner's
    estimate, so that it would send such a table through the driver to all executors, however large it is."""
    return left.join(right.hint("merge"), on, how)
