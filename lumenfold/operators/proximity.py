"""What stands near a place of its unit, or is missing there: range semi- and anti-joins, and sizes compared over them.

Places are whole numbers (lines or offsets) within a unit (a file or function). They are dealt to bins as wide as the span
that is looked at, so that the joins are by equality on unit and bin: a large unit is cut up, only neighbours are compared,
and of equal marks one is kept. A null unit or place is near nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near(points: DataFrame, marks: DataFrame, keys: list[str], before: int, after: int, missing: bool = False) -> DataFrame:
    """The points (keys, place, any others) with a mark (keys, place) of the same keys in [place - before, place + after];
    missing: those without one. Points come once each, repeated ones as often as they are there."""
    width = before + after + 1
    low, high = F.col("m_place") - after, F.col("m_place") + before  # the points that a mark is near to
    told = marks.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("place").cast("long").alias("m_place")).dropna().distinct()
    told = told.withColumn("m_bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    same = [F.col(k) == F.col(f"m_{k}") for k in keys]
    here = F.floor(F.col("place") / width) == F.col("m_bin")
    return points.join(told, [*same, here, F.col("place").between(low, high)], "left_anti" if missing else "left_semi")


def outgrown(allocs: DataFrame, loops: DataFrame, copies: DataFrame, reach: int = 60) -> DataFrame:
    """unit, line, names, others, loop: allocations whose size names none of the bounds that a loop nearby runs to.

    allocs: unit, line, pos (order on a line), names (array; none or null: left out); loops: unit, line, bound (null if the
    loop has no single name); copies: unit, line of copies by a type's size. Loops and copies count in the `reach` lines
    from the allocation's. others: the bounds that the size doesn't name, in order; loop: the first loop's line. Of a line's
    allocations the first that is found stays.
    """
    rows = allocs.select("unit", F.col("line").cast("long").alias("place"), "pos", F.array_sort(F.array_distinct("names")).alias("names")).filter(F.size("names") > 0)
    rows = near(rows, copies.select("unit", F.col("line").alias("place")), ["unit"], 0, reach - 1)
    # bounds of a line together, so that an allocation meets at most `reach` rows
    by_line = loops.filter("line is not null").groupBy("unit", F.col("line").cast("long").alias("loop")).agg(F.collect_set("bound").alias("bounds"))
    by_line = by_line.withColumn("bin", F.floor(F.col("loop") / reach))
    dealt = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("place") / reach), F.floor((F.col("place") + reach - 1) / reach))))
    met = dealt.join(by_line, ["unit", "bin"]).filter(F.col("loop").between(F.col("place"), F.col("place") + reach - 1))
    told = met.groupBy("unit", "place", "pos", "names").agg(F.array_distinct(F.flatten(F.collect_list("bounds"))).alias("bounds"), F.min("loop").alias("loop"))
    told = told.withColumn("others", F.array_sort(F.array_except("bounds", "names"))).filter(F.size("others") > 0)
    first = F.min_by(F.struct("names", "others", "loop"), F.struct("pos", "names"))
    return told.groupBy("unit", "place").agg(first.alias("f")).select("unit", F.col("place").alias("line"), "f.*")


def overflow(size: Column, most: Column) -> Column:
    """Whether what is copied, `most` at the utmost, can be more than a buffer's size: YES, NO, or UNKNOWN where one is null."""
    return F.when(size.isNull() | most.isNull(), "UNKNOWN").when(most > size, "YES").otherwise("NO")


def overrun(buffers: DataFrame, copies: DataFrame) -> DataFrame:
    """unit, line, issue, confidence: copies into buffers that they can outgrow.

    buffers: unit, kind (stack or heap), name, pos, size (null: not known); of a name's buffers of a kind in a unit the last
    one counts, of those at one place the smallest. copies: unit, line, name (of what is written), most. A stack buffer is
    also told where one of the two isn't known. Each issue of a line once.
    """
    last = buffers.groupBy("unit", "kind", "name").agg(F.max_by("size", F.struct("pos", F.coalesce(-F.col("size"), F.lit(-(2**62))))).alias("size"))
    met = copies.join(last, ["unit", "name"]).withColumn("can", overflow(F.col("size"), F.col("most")))
    issue = F.when(F.col("can") == "YES", F.concat("kind", F.lit("-buffer-overflow"))).when((F.col("can") == "UNKNOWN") & (F.col("kind") == "stack"), "potential-stack-overflow")
    told = met.select("unit", "line", issue.alias("issue"), F.when(F.col("can") == "YES", "HIGH").otherwise("LOW").alias("confidence"))
    return told.filter("issue is not null").distinct()
