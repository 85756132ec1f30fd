"""Relations between events or findings of one key: what comes after, what repeats, what nothing guards, what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_after(rows: DataFrame, key: str, at: str, opens: Column, uses: Column) -> DataFrame:
    """key, opened, used: for each key the first row that `uses` after the first one that `opens` (use after release).

    One aggregate and one window over the key's rows in order; keys without a later use have no row.
    """
    opened = F.min(F.when(opens, F.col(at))).over(Window.partitionBy(key))
    told = rows.withColumn("opened", opened).filter(uses & (F.col(at) > F.col("opened")))
    return told.groupBy(key).agg(F.min("opened").alias("opened"), F.min(at).alias("used"))


def repeated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of each key in order, with their number n (release of what is released)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).filter("n > 1")


def unguarded(rows: DataFrame, guards: DataFrame, key: str, at: str, reach: int) -> DataFrame:
    """Rows that no guard of the same key covers: a guard covers from its own `at` to `reach` further, both included.

    Numbers only. The last guard before a row is found by one window over both, so nothing is joined pair by pair.
    """
    both = rows.withColumn("__guard", F.lit(None).cast("long")).unionByName(
        guards.select(key, at).withColumn("__guard", F.col(at).cast("long")), allowMissingColumns=True
    )
    upto = Window.partitionBy(key).orderBy(F.col(at), F.col("__guard").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__last", F.last("__guard", ignorenulls=True).over(upto)).filter("__guard is null")
    return told.filter(F.col("__last").isNull() | (F.col(at) - F.col("__last") > reach)).drop("__guard", "__last")


def remaining(every: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """What is in every, but not in changed."""
    return every.join(changed.select(key).distinct(), key, "left_anti")


def with_defaults(rows: DataFrame, more: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join by key; what misses gets its default."""
    return rows.join(more, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def edge_counts(edges: DataFrame) -> DataFrame:
    """src, n_edges: distinct targets of each source."""
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("n_edges"))


def savings(scanned: Column, skipped: Column) -> Column:
    """Per cent of files that need no scan; 0 where there are none."""
    total = scanned + skipped
    return F.when(total > 0, F.round(skipped * 100.0 / total, 1)).otherwise(0.0)


def store_stats(entries: DataFrame, key: str, at: str) -> DataFrame:
    """Entries of a store by key: how many, and the first and last time."""
    return entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"))


def purged(entries: DataFrame, files: DataFrame, before: Column, at: str) -> DataFrame:
    """Entries (path, at) without those that are older than `before` and whose file is gone."""
    stale = entries.filter(F.col(at) < before).select("path").join(files.select("path"), "path", "left_anti").distinct()
    old = entries.filter(F.col(at) < before).join(stale, "path", "left_anti")
    return old.unionByName(entries.filter(~(F.col(at) < before) | F.col(at).isNull()))


def without_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose path does not begin with the prefix, which is taken as it is."""
    return entries.filter(~F.col("path").startswith(prefix) | F.col("path").isNull())
