"""Scan history: differences to the scan before, trends, gates, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(scans: DataFrame) -> DataFrame:
    """Each scan with the change of its total since the project's scan before, and what that means."""
    w = Window.partitionBy("project").orderBy("ts", "scan_id")
    before = F.lag("total").over(w)
    change = (F.col("total") - before).alias("change")
    label = F.when(before.isNull(), "first").when(F.col("total") < before, "improving")
    label = label.when(F.col("total") > before, "worsening").otherwise("stable").alias("trend")
    return scans.select("project", "scan_id", "total", change, label)


def gate(scans: DataFrame, most_critical: int, most_high: int) -> DataFrame:
    """Whether a scan passes, with the reasons where it doesn't."""
    why = F.concat_ws(
        "; ",
        F.when(F.col("critical") > most_critical, F.concat(F.lit("critical "), F.col("critical"))),
        F.when(F.col("high") > most_high, F.concat(F.lit("high "), F.col("high"))),
    )
    return scans.select("project", "scan_id", why.alias("reasons"), (why == "").alias("passed"))


def latest(scans: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("scan_id"))
    return scans.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")


def as_json(scans: DataFrame, columns: list[str], keep: int) -> DataFrame:
    """value: each project's last `keep` scans in order of time, as one JSON list."""
    held = F.sort_array(F.collect_list(F.struct("ts", "scan_id", F.struct(*columns).alias("told"))))
    return latest(scans, keep).groupBy("project").agg(F.to_json(F.transform(held, lambda x: x["told"])).alias("value"))
