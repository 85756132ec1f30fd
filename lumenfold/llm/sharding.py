"""Shards by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import stash

#: Shards to a rack and racks to a region of the default tree.
FANOUT = (2, 2)
#: Rows of a hashed cell of a shard, on the mean; each cell is numbered by itself.
CELL = 20_000
#: Up to so many cells their starts (20 bytes each) go to every executor; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 500_000


def default_tree(shards: int, base: int = 8, fanout: tuple[int, int] = FANOUT) -> dict[int, tuple[int, int, float]]:
    """shard -> (region, rack, weight). The first `base` shards fill racks and regions in order; each later shard
    opens a region of its own, so that what it takes cannot pass through the subtree of an older one."""
    per_rack, racks = fanout
    tree = {s: (s // (per_rack * racks), s // per_rack, 1.0) for s in range(min(shards, base))}
    regions = math.ceil(min(shards, base) / (per_rack * racks))
    tree |= {s: (regions + s - base, base + s, 1.0) for s in range(base, shards)}
    return tree


def _draw(key: Column, level: str, nodes: dict[int, float]) -> Column:
    """The node with the largest weighted draw: weight / -ln(u), u hashed from level, node and key."""
    drawn = []
    for node, weight in sorted(nodes.items()):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(node), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        drawn.append(F.struct((F.lit(weight) / -F.log(u)).alias("draw"), F.lit(node).alias("node")))
    return F.array_max(F.array(*drawn))["node"] if len(drawn) > 1 else F.lit(next(iter(nodes)))


def place(key: Column, tree: dict[int, tuple[int, int, float]]) -> Column:
    """Descend from the root: weighted draw of a region, of a rack in it, of a shard in that.

    A node's weight is that of the shards below it. If weights change in one subtree only, a row leaves its node at
    any level only for a node whose weight grew, so movement stays within the subtrees that changed.
    """
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[int, dict[int, float]] = defaultdict(dict)
    for shard, (region, rack, weight) in tree.items():
        regions[region] += weight
        racks[region][rack] += weight
        shards[rack][shard] = weight

    def switch(at: Column, cases: dict[int, Column]) -> Column:
        out = F.lit(None).cast("int")
        for value, then in cases.items():
            out = F.when(at == value, then).otherwise(out)
        return out

    region = _draw(key, "region", regions)
    within = {
        r: switch(_draw(key, f"rack{r}", inner), {k: _draw(key, f"shard{k}", shards[k]) for k in inner})
        for r, inner in racks.items()
    }
    return switch(region, within).cast("int")


def shard_rows(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, under the law `key`.

    Shard and grown shard follow from the id and the number of shards alone; with one shard more, rows move only
    into the new one. Slots number each shard's rows from 0 without gaps, ordered by hashed cell and then id: each
    (shard, cell) is numbered on its own and shifted by the rows of the cells before it, so that no shard is ever
    in one task. Cells grow in number with the rows, so that a cell does not grow.

    A null text has size 1 and checksum 0, a very long one is hashed where it is read. All rows with one id, or a null
    one, go to one shard, as the law asks, but their cell follows from id, checksum and size, so that many of them are
    not in one task; slots go by these three within a cell, so that only rows equal in all may change places. An empty table gives an empty result; further columns are ignored.
    """
    if cells is None:
        cells = max(64, math.ceil(docs.count() / shards / CELL))
    from pyspark.sql import Window

    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    seed = F.xxhash64(F.lit("cell"), "doc_id", "text_crc32", "size")
    placed = stash(
        sized.select(
            "*",
            place(F.col("doc_id"), default_tree(shards)).alias("shard"),
            place(F.col("doc_id"), default_tree(shards + 1, shards)).alias("grown_shard"),
            F.pmod(seed, F.lit(cells)).cast("int").alias("cell"),
        )
    )
    counts = placed.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(own) - 1)
        .join(F.broadcast(starts) if shards * cells <= BROADCAST_CELLS else starts, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
