"""Outputs of version control as tables: changed paths, counts of lines, numbers of changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numstat(rows: DataFrame) -> DataFrame:
    """text -> path, additions, deletions; a dash counts as 0. A line without three fields is a path alone."""
    f = F.split("text", "\t", 3)
    whole = F.size(f) >= 3
    def count(k: int) -> Column:
        """Null, and so 0, where the field is a dash or no number."""
        return F.coalesce(F.when(whole, F.get(f, F.lit(k)).try_cast("long")), F.lit(0).cast("long"))

    path = F.trim(F.when(whole, F.get(f, F.lit(2))).otherwise(F.col("text")))
    return rows.select(path.alias("path"), count(0).alias("additions"), count(1).alias("deletions"))


def name_status(rows: DataFrame) -> DataFrame:
    """text -> path (the last field: a rename's new one), status (its first letter), old_path (of a rename, else null)."""
    f = F.split("text", "\t")
    old = F.when(F.size(f) > 2, F.get(f, F.lit(1)))
    return rows.filter(F.size(f) > 1).select(F.element_at(f, -1).alias("path"), F.left(F.get(f, F.lit(0)), F.lit(1)).alias("status"), old.alias("old_path"))


def changed_lines(rows: DataFrame) -> DataFrame:
    """(diff, at, text) of unified diffs, in order of `at` -> diff, path, line: each added line's number in the new file.

    A hunk's header gives the first number; each later line but a removed one counts on from it.
    """
    upto = Window.partitionBy("diff").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    names_file, opens = F.col("text").startswith("+++ b/"), F.col("text").startswith("@@")
    told = rows.withColumns(
        {
            "path": F.last(F.when(names_file, F.trim(F.substring("text", 7, 1 << 20))), ignorenulls=True).over(upto),
            "hunk": F.count_if(opens).over(upto),
            "first": F.last(F.when(opens, F.regexp_extract("text", r"\+(\d+)", 1).cast("long")), ignorenulls=True).over(upto),
        }
    )
    told = told.filter(F.col("path").isNotNull() & (F.col("hunk") > 0) & ~opens & ~names_file & ~F.col("text").startswith("--- "))
    before = Window.partitionBy("diff", "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.count_if(~F.col("text").startswith("-")).over(before), F.lit(0))
    told = told.withColumn("line", F.col("first") + passed)
    return told.filter(F.col("text").startswith("+")).select("diff", "path", "line")
