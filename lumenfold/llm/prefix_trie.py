"""A trie of conversations that share their first turns: rolling fingerprints, verified groups, rollups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, stash

#: A fingerprint is two sums of turn hashes times powers of these bases, modulo PRIME; products fit into 64 bits.
BASES, PRIME = (1_103_515_249, 48_271_007), (1 << 31) - 1
#: A rebuilt conversation takes fewer turns than this from the first of its FAMILY of neighbouring ids.
HEADS, FAMILY = 9, 5
#: Depths that a window sums over at once, and the bits of ids whose decimals are joined at once.
BLOCK, ID_BITS = 65_536, 12
KEY = ["depth", "f", "path"]


def powers(base: int, n: int, prime: int) -> np.ndarray:
    """base to the 0 .. n-1, modulo prime."""
    out = np.ones(max(n, 1), np.int64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * pow(base, done, prime) % prime
        done += step
    return out


def scanned(conversations: DataFrame, prime: int) -> DataFrame:
    """conv_id, part, place, g1, g2, v1, v2, bytes, role, text: each turn with its place among its conversation's turns
    of the same part, its share v of the fingerprint and the sum g of the shares up to it.

    Rows are dealt by ranges of conversation and turn, so that a conversation of any length is spread over parts; equal
    keys of a range are at most the turns with one number and the same beginning.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_conv, open_place, open_sums = None, 0, (0, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy()
            x = batch.column(1).to_numpy().view(np.uint64)
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            first = np.repeat(begins, np.diff(np.r_[begins, n]))
            goes_on = (first == 0) & (conv[0] == open_conv)
            index = np.arange(n) - first
            place = index + 1 + np.where(goes_on, open_place, 0)
            sums, shares = [], []
            for k, base in enumerate(BASES):
                share = (x >> np.uint64(31 * k)).astype(np.int64) % prime * powers(base % prime, n + 1, prime)[index + 1] % prime
                share = np.where(goes_on, share * pow(base, open_place, prime) % prime, share)
                total = np.cumsum(share)
                sums.append((total - (total - share)[first] + np.where(goes_on, open_sums[k], 0)) % prime)
                shares.append(share)
            open_conv, open_place, open_sums = conv[-1], int(place[-1]), (int(sums[0][-1]), int(sums[1][-1]))
            made = [np.full(n, part), place, *sums, *shares]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c.astype(np.int64)) for c in made), *batch.columns[2:]],
                names=["conv_id", "part", "place", "g1", "g2", "v1", "v2", "bytes", "role", "text"],
            )

    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")),
    )
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.left("role", F.lit(16)), F.left("text", F.lit(32)))
    sorted_rows = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    narrow = sorted_rows.select(
        "conv_id", F.xxhash64("role", "text").alias("x"), F.octet_length("text").cast("long").alias("bytes"), "role", "text"
    )
    kinds = ", ".join(f"{c} long" for c in ("conv_id", "part", "place", "g1", "g2", "v1", "v2", "bytes"))
    return stash(narrow.mapInArrow(scan, f"{kinds}, role string, text string"), 4_000)


def placed(turns: DataFrame, prime: int) -> DataFrame:
    """turns with pos among all turns of the conversation, and g and v over all of them.

    Only conversations that lie in several parts need it; they are fewer than there are parts, and so is each one's list.
    """

    def carried(key: tuple, part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["part"])
        off, sums, out = 0, [0, 0], []
        for r in rows:
            lifts = [pow(b, off, prime) for b in BASES]
            out.append((key[0].as_py(), r["part"], off, *lifts, *sums))
            sums = [(s + lift * r[c]) % prime for s, lift, c in zip(sums, lifts, ("g1", "g2"), strict=True)]
            off += r["n"]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["conv_id", "part", "off", "b1", "b2", "c1", "c2"]
    last = F.max_by(F.struct("g1", "g2"), "place").alias("g")
    spans = stash(turns.groupBy("conv_id", "part").agg(F.max("place").alias("n"), last).select("conv_id", "part", "n", "g.*"))
    several = spans.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    moved = spans.join(several, "conv_id").groupBy("conv_id").applyInArrow(carried, ", ".join(f"{c} long" for c in names))
    moved = stash(moved)
    discard(spans)
    rows = turns.join(F.broadcast(moved), ["conv_id", "part"], "left")
    lifted = {
        c: F.when(F.col("off").isNull(), F.col(c)).otherwise((F.col(b) * F.col(c) + carry) % prime)
        for c, b, carry in (("g1", "b1", F.col("c1")), ("g2", "b2", F.col("c2")), ("v1", "b1", 0), ("v2", "b2", 0))
    }
    pos = (F.col("place") + F.coalesce("off", F.lit(0))).alias("pos")
    return rows.select("conv_id", pos, *(e.alias(c) for c, e in lifted.items()), "bytes", "role", "text")


def joined(one: Column, two: Column) -> Column:
    return one * (1 << 31) + two


def rebuilt(conversations: DataFrame, prime: int) -> tuple[DataFrame, DataFrame]:
    """convs: conv_id, base, m, heads (the first m turns, taken from base: pos, g1, g2, bytes), length;
    own: conv_id, depth, f, before (f one turn earlier), bytes, role, text of the turns that follow.

    The fingerprint of a rebuilt prefix is algebra on those of the two conversations: what stands before is exchanged
    and the rest moved by a power of the base. So no text is copied and no second scan made.
    """
    turns = placed(scanned(conversations, prime), prime)
    told = F.when(F.col("pos") < HEADS, F.struct("pos", "g1", "g2", "bytes"))
    whole = stash(turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(told)).alias("heads")))
    c = F.col("conv_id")
    h = F.when(c % FAMILY == 0, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % HEADS)
    base = whole.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("theirs"))
    convs = whole.select("conv_id", "n", F.col("heads").alias("mine"), (c - c % FAMILY).alias("base"), h.cast("int").alias("h"))
    convs = convs.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)).cast("int")))

    def at(heads: str, pos: Column, field: str) -> Column:
        return F.when(pos > 0, F.try_element_at(heads, pos)[field]).otherwise(0)

    own_heads = F.least("h", F.col("n").cast("int"))
    convs = stash(convs.select(
        "conv_id", "base", "h", "m", F.slice(F.coalesce("theirs", "mine"), F.lit(1), F.col("m")).alias("heads"),
        (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *(at("mine", own_heads, f"g{k}").alias(f"h{k}") for k in (1, 2)), *(at("theirs", F.col("m"), f"g{k}").alias(f"m{k}") for k in (1, 2)),
    ))
    discard(whole)
    rows = turns.join(convs.drop("heads", "base"), "conv_id").filter("pos > h")

    def lane(k: int, g: Column) -> Column:
        back = F.array(*(F.lit(pow(BASES[k - 1], -i, prime)).cast("long") for i in range(HEADS)))
        shift = F.element_at(back, F.col("h") - F.col("m") + 1)
        return (F.col(f"m{k}") + shift * F.pmod(g - F.col(f"h{k}"), F.lit(prime))) % prime

    own = rows.select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"),
        joined(lane(1, F.col("g1")), lane(2, F.col("g2"))).alias("f"),
        joined(lane(1, F.col("g1") - F.col("v1")), lane(2, F.col("g2") - F.col("v2"))).alias("before"),
        "bytes", "role", "text",
    )
    return convs, stash(own)


def split(own: DataFrame) -> DataFrame:
    """conv_id, depth, sub: turns that differ from the representative of those with their depth and fingerprint.

    Each turn of a group is compared with that of the group's smallest conversation: role, text and the fingerprint of
    what stands before. Those that differ (collisions) are compared among themselves again, until all have found their
    like; sub numbers these rounds. A turn copied from a base is the base's own, which is in the same group.
    """
    left, found, sub = own, None, 0
    while True:
        groups = left.groupBy("depth", "f").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).filter("n > 1" if not sub else "n > 0")
        groups = stash(groups.select("depth", "f", "rep"))
        first = left.join(groups.withColumnRenamed("rep", "conv_id"), ["depth", "f", "conv_id"])
        first = stash(first.select("depth", "f", *(F.col(c).alias(f"{c}_") for c in ("before", "role", "text"))))
        same = (F.col("before") == F.col("before_")) & (F.col("role") == F.col("role_")) & (F.col("text") == F.col("text_"))
        told = left.join(first, ["depth", "f"])
        if sub:
            settled = stash(told.filter(same).select("conv_id", "depth", F.lit(sub).alias("sub")))
            found = settled if found is None else found.union(settled)
        rest = stash(told.filter(~same).select(*own.columns))
        discard(groups, first)
        if rest.isEmpty():
            return found
        left, sub = rest, sub + 1


def members(convs: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, depth, f, path, before, before_path, bytes, ends: each rebuilt conversation at each depth.

    depth, f and path name a node; path lists the collisions that its turns went through and is nearly always empty.
    """
    length = convs.select("conv_id", "length")
    head = convs.select("conv_id", "length", F.posexplode("heads").alias("i", "t"), "heads")
    prior = F.when(F.col("i") > 0, F.try_element_at("heads", F.col("i")))
    heads = head.select(
        "conv_id", F.col("t.pos").alias("depth"), joined(F.col("t.g1"), F.col("t.g2")).alias("f"),
        F.coalesce(joined(prior["g1"], prior["g2"]), F.lit(0)).alias("before"), F.col("t.bytes").alias("bytes"), "length",
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("f"), F.lit(None).cast("long").alias("before"), zero.alias("bytes"), "length")
    rows = own.select("conv_id", "depth", "f", "before", "bytes").join(length, "conv_id").unionByName(heads).unionByName(roots)
    collided = split(own)
    if collided is None:
        rows = rows.withColumns({"path": F.lit(""), "before_path": F.lit("")})
    else:
        copied = convs.filter("m > 0").select("conv_id", "m", "base").join(collided.withColumnRenamed("conv_id", "base"), "base")
        every = collided.unionByName(copied.filter("depth <= m").select("conv_id", "depth", "sub"))
        lists = every.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "sub"))).alias("subs"))
        rows = rows.join(stash(lists), "conv_id", "left")

        def path(depth: Column) -> Column:
            kept = F.filter(F.coalesce("subs", F.array().cast("array<struct<depth:bigint,sub:int>>")), lambda s: s["depth"] <= depth)
            return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["depth"], s["sub"])), ",")

        rows = rows.withColumns({"path": path(F.col("depth")), "before_path": path(F.col("depth") - 1)})
    ends = (F.col("depth") == F.col("length")).cast("long").alias("ends")
    return stash(rows.select("conv_id", *KEY, "before", "before_path", "bytes", ends))


def digests(ends: DataFrame) -> DataFrame:
    """depth, f, path, ends_sha256 of the ids in ends (depth, f, path, conv_id), ascending.

    Decimals are joined for blocks of neighbouring ids; a node's blocks then stream through one hash in order, which SHA-256
    asks for, so nothing of a node is held but its hash state.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(done)
        if node:
            yield made([(*node, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "ends_sha256"])

    block = F.shiftright("conv_id", ID_BITS).alias("block")
    joined_ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    blocks = ends.groupBy(*KEY, block).agg(joined_ids)
    dealt = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "block", "ids")
    return dealt.mapInArrow(hashed, "depth long, f long, path string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, prime: int = PRIME) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn (null first), equal turns by role and text; null role and text are empty; each row
    is a turn, repeated rows too. A conversation c is rebuilt from the first h turns of c - c % 5, h = CRC-32 of its
    decimal id % 9, and its own after its first h (% keeps the sign of a negative id). A node is a distinct sequence of
    the first d rebuilt turns, from the root (d = 0) on, and conv_id its smallest member. Rows with a null conv_id belong
    to no conversation. An empty table has no node; further columns are ignored.

    1. Turns are sorted by ranges and scanned in numpy: a polynomial rolling fingerprint of every prefix.
    2. Prefixes with equal depth and fingerprint are a candidate group; every turn of it is compared with its
       representative's, and collisions are split (prime is small only where a test wants collisions).
    3. Groups are counted map-side first. A node's subtree is summed over its members: of each conversation only what it
       represents, below the depth in question, so that nothing goes level by level and each node counts once.

    Long conversations lie in several parts and are summed in blocks of depths. A very long text is compared where its
    group has two members and is otherwise only hashed.
    """
    convs, own = rebuilt(conversations, prime)
    rows = members(convs, own)
    nodes = stash(rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("before").alias("before"),
        F.min("before_path").alias("before_path"), F.min("bytes").alias("bytes"),
    ))
    up = [(F.col("depth") - 1).alias("depth"), F.col("before").alias("f"), F.col("before_path").alias("path")]
    below = nodes.filter("depth > 0").select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    family = stash(nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # what a conversation represents: its nodes' saved bytes, and one leaf where it is the leaf's smallest member
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    own_part = family.select("conv_id", "depth", saved.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    own_part = own_part.filter("saved > 0 or leaf > 0")
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    from_here = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    sums = rows.select("conv_id", *KEY, block).join(own_part, ["conv_id", "depth"], "left")
    sums = sums.select("conv_id", "block", *KEY, *(F.sum(F.coalesce(c, F.lit(0))).over(from_here).alias(c) for c in ("saved", "leaf")))
    onward = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own_part.groupBy("conv_id", block).agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    long_ones = convs.filter(F.col("length") >= BLOCK).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / BLOCK))).alias("block"))
    later = stash(long_ones.join(blocks, ["conv_id", "block"], "left").select(
        "conv_id", "block", *(F.coalesce(F.sum(c).over(onward), F.lit(0)).alias(c) for c in ("s", "l"))
    ))
    if not later.isEmpty():
        sums = sums.join(later, ["conv_id", "block"], "left")
        sums = sums.select(*KEY, *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("saved", "s"), ("leaf", "l"))))
    subtree = sums.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select(F.col("depth").alias("d"), F.col("f").alias("before"), F.col("path").alias("before_path"), F.col("conv_id").alias("parent_conv_id"))
    out = family.join(subtree, KEY).join(digests(rows.filter("ends > 0").select(*KEY, "conv_id")), KEY, "left")
    out = out.withColumn("d", F.col("depth") - 1).join(parents, ["d", "before", "before_path"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
