"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import SPACE, discard, stash

#: Up to so many surviving (length, prefix) keys go to every executor (12 bytes each); beyond, rows are shuffled.
BROADCAST_KEYS = 200_000


def squeezed(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digest_all: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without white space. Of equal ones stays the row with the most code
    points in its original text, then the smallest id. Each level refines the groups the level before left with two
    or more rows: (1) length, (2) length and hash of the first characters, (3) SHA-256 of the whole squeezed text,
    computed for surviving rows only unless digest_all asks for everybody's; text_sha256 is null where it was not
    needed. Levels 1 and 2 run on a narrow table of lengths and hashes. A hot group is counted map-side and joined
    back by a join that can be split; texts themselves are shuffled only if the surviving keys exceed BROADCAST_KEYS.

    Null and empty texts form one group. Ids may be of any type that has an order. Repeated rows with one id share
    their keep_id and are kept or dropped alike. Rows with a null id come last: they give way to any other row of their
    group, and where all ids are null keep_id is null and kept false. A very long text is read whole, where its prefix
    is shared. An empty table gives an empty result; further columns of docs are ignored, whatever their names.
    """
    squeeze = squeezed(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        "text",
        F.octet_length(squeeze).alias("size"),
        F.xxhash64(F.substring(squeeze, 1, prefix_chars)).alias("head"),
    )
    narrow = stash(rows.select("size", "head"))
    same_size = stash(narrow.groupBy("size").count().filter("count > 1").select("size"))
    left = narrow.join(same_size, "size", "left_semi")
    same_head = stash(left.groupBy("size", "head").count().filter("count > 1").select("size", "head"))
    survives = same_head.withColumn("survives", F.lit(True))
    if same_head.count() <= BROADCAST_KEYS:
        survives = F.broadcast(survives)
    digest = F.sha2(squeeze.cast("binary"), 256)
    hashed = stash(
        rows.join(survives, ["size", "head"], "left").select(
            "doc_id",
            F.length(F.coalesce("text", F.lit(""))).alias("points"),
            F.coalesce("survives", F.lit(False)).alias("survives"),
            (digest if digest_all else F.when(F.col("survives"), digest)).alias("text_sha256"),
        )
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("points")).alias("less"), "doc_id"))
    groups = stash(
        hashed.filter("survives")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    )
    discard(narrow, same_size, same_head)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    if digest_all:
        told = hashed.join(groups, "text_sha256", "left")
    else:  # rows without a digest are told apart already; as null keys of the join they would all meet in one task
        alone = hashed.filter("not survives").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(None).cast("long")})
        told = hashed.filter("survives").join(groups, "text_sha256", "left").unionByName(alone)
    return told.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )
