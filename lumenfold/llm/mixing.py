"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import SPACE, placed, stash, text_keys

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source and no document is taken more often than this.
MOST = 3.0
#: Hashes of repeated rows that go to every executor; beyond, a shuffled join finds the rows.
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with target.

    Targets share the sum of all sizes by weight and stop at most x source_size; the excess is reshared by weight
    until none is above. That is the level L with sum(min(cap, L x weight)) = total: sources are sorted by
    cap / weight, and L is taken where the first source stays below its cap. One row per source, so the windows run
    in one task over as many rows as there are sources, not documents: meant for up to some millions of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    told = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    told = told.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    told = told.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    holds = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    level = F.first(holds, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return told.select("source", "source_size", share.alias("target"))


def copies(key: list[Column], rate: Column, seed: int) -> Column:
    """floor(rate), plus one with probability equal to the fraction, drawn from a hash of key (nulls left out) and seed."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def keys(row: str) -> list[Column]:
    """by_id: a hash of the id, null without one; by_all: of id, source and text."""
    doc_id, source, text = (F.col(f"{row}.{c}") for c in ("doc_id", "source", "text"))
    by_id = F.when(doc_id.isNotNull(), F.xxhash64(doc_id))
    return [by_id.alias("by_id"), F.xxhash64(doc_id, source, *text_keys(text)).alias("by_all")]


def _several(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    found = rows.groupBy(key).count().filter(f"count > 1 and {key} is not null")
    found = stash(found.select(key, F.lit(True).alias(f"{key}_shared")))
    n = found.count()
    return F.broadcast(found) if n <= BROADCAST_ROWS else found, n


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (by_id, by_all, file, place, ...) with drawn_by: null where the id is the row's own; else by_all, hashed with
    file and place where several rows have the same, so that each row is drawn by itself."""
    ids, n_ids = _several(rows, "by_id")
    if not n_ids and rows.filter("by_id is null").isEmpty():
        return rows.withColumn("drawn_by", F.lit(None).cast("long"))
    rows = rows.withColumn("lone", F.coalesce("by_id", "by_all"))  # rows without an id do not meet in one task
    rows = rows.join(ids.withColumnRenamed("by_id", "lone"), "lone", "left")
    unclear = F.col("by_id").isNull() | F.coalesce("by_id_shared", F.lit(False))
    rows = rows.withColumn("by_all", F.when(unclear, F.col("by_all")))
    same, _ = _several(rows, "by_all")
    rows = rows.withColumn("lone", F.coalesce("by_all", "by_id")).join(same.withColumnRenamed("by_all", "lone"), "lone", "left")
    alone = F.when(F.col("by_all_shared") & F.col("by_all").isNotNull(), F.xxhash64("by_all", "file", "place"))
    return rows.withColumn("drawn_by", F.coalesce(alone, "by_all")).drop("lone", "by_id_shared", "by_all_shared")


def rates(docs: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs.

    A null text or one without words has size 0; null is a source of its own, after all others. A source of size 0
    has target 0 and is not taken. A row is drawn by its id; rows that share one, or have none, by source and
    text too, and rows equal in all of these by the name of their file and their place in it as well, so that a source of such rows, or without ids, comes as near its target
    as any. An empty table gives an empty result; further columns are ignored; a very long text is one regular
    expression's count, in one pass. Word counts are taken in one scan of the texts and written; sources are summed map-side first, and the sums are
    joined back by a join that can be split, so that a source with a third of all rows is harmless. Two runs give the
    same copies.
    """
    told = placed(docs.select(F.col(id_col).alias("doc_id"), "source", "text"))
    sized = stash(told.select("row.doc_id", "row.source", n_words(F.col("row.text")).alias("size"), *keys("row"), "file", "place"))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = stash(aims).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return told_apart(sized).join(aims, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", copies([F.col("doc_id"), F.col("drawn_by")], rate, seed).alias("copies")
    )


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs with each row repeated as the mix takes it, columns unchanged, whatever their names.

    The rates and draws come as in rates(), for null texts, ids and sources too; an empty table stays empty. A document's
    copies are made where it is read, one behind the other, from a narrow table of one rate per source, so that texts are
    not shuffled for it (they are if more than BROADCAST_ROWS rows are repeated).
    """
    sizes = docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source")
    aims = stash(targets(sizes.agg(F.sum("size").alias("source_size")))).select(
        F.col("source").alias("of"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    rows = told_apart(placed(docs).select("*", *keys("row")))
    drawn = rows.join(aims, F.col("row.source").eqNullSafe(F.col("of")))
    n = copies([F.col("row.doc_id"), F.col("drawn_by")], F.col("rate"), seed).cast("int")
    taken = drawn.withColumn("n", n).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
