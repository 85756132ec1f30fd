"""Near duplicates by fast similarity sketching, banding, and a check on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import components, discard, stash, text_keys
from lumenfold.llm.shingles import forget, mixed, shingle_set

#: Coordinates of a sketch, in bands of ROWS: a pair at similarity 0.75 shares no band with probability 6e-6.
BINS, ROWS = 128, 4
#: Texts whose keys (24 bytes) are sent to every executor to pick them during the scan; beyond, a shuffle joins them.
BROADCAST_KEYS = 500_000
#: Members of a bucket that meet in one task, twice.
BLOCK = 128
#: Turns of random blocks before all labels of a key meet, at most, and as long as one link comes of so many members.
MOST_TURNS, TURN_GAIN = 8, 50
#: Pairs of one pivot that meet its set in one task; the set of a pivot with more is sent out several times.
HUB = 64
_FRACTION = np.uint64((1 << 48) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mixed(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value for each bin, none empty, from a set of at least one hash.

    In round i < bins every item falls into a hashed bin with value i + a hashed fraction; in round bins + b every
    item falls into bin b. Each bin keeps its least value, and rounds end when no bin is empty, so a large set needs
    two or three, and 2 x bins are always enough. Rounds run in blocks: a later round never lowers a filled bin.
    """
    out = np.full(bins, _EMPTY)
    n = len(items)
    done = 0
    while done < bins:
        block = min(bins - done, max(1, -(-bins * 4 // n)))
        x = mixed(items[None, :] ^ _SEEDS[done : done + block, None])
        value = (np.arange(done, done + block, dtype=np.uint64)[:, None] << np.uint64(48)) | (x & _FRACTION)
        np.minimum.at(out, ((x >> np.uint64(48)) % np.uint64(bins)).ravel().astype(np.intp), value.ravel())
        done += block
        if not (out == _EMPTY).any():
            return out
    for b in np.flatnonzero(out == _EMPTY):
        x = mixed(items ^ _SEEDS[bins + b])
        out[b] = (np.uint64(bins + b) << np.uint64(48)) | (x & _FRACTION).min()
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = values.reshape(-1, rows)
    acc = mixed(np.arange(1, len(grid) + 1, dtype=np.uint64))
    for k in range(rows):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return acc.view(np.int64)


def sketched(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, k1, k2 (of the text), n_shingles, set_key (null without words), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys = [], [], []
            for text in batch.column(3):
                items = shingle_set(text.as_py(), shingle)
                sizes.append(len(items))
                names.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                keys.append(band_keys(sketch(items)) if len(items) else None)
            told = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), told],
                names=["doc_id", "k1", "k2", "n_shingles", "set_key", "keys"],
            )
        forget()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, n_shingles long, set_key binary, keys array<bigint>"
    )


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id, items: the full shingle sets of the texts with the keys in wanted (id, k1, k2; one row for each text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                items = [shingle_set(t.as_py(), shingle).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], names=["id", "items"])
        forget()

    wanted = stash(wanted)
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    rows = docs.select("text", *text_keys(F.col("text"))).join(wanted, ["k1", "k2"]).select("id", "text")
    return stash(rows.mapInArrow(run, "id long, items binary").dropDuplicates(["id"]), 1000)


def confirmed(docs: DataFrame, pairs: DataFrame, where: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The (a, b) of pairs with 100 x intersection >= percent x union, counted on the full sets; where: id, k1, k2.

    Each b is in one pair, an a may be in very many: then its set is sent out once for each HUB of them, and its pairs
    are dealt among these, so that no task holds all pairs of a popular a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, ids.join(where, "id"), shingle)
    hubs = pairs.groupBy("a").count().filter(F.col("count") > HUB)
    hubs = stash(hubs.select("a", F.ceil(F.col("count") / HUB).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("b"), parts).cast("int").alias("part")
    dealt = pairs.join(hubs, "a", "left").select("a", "b", part)
    b_side = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    a_side = sets.select(F.col("id").alias("a"), F.col("items").alias("x")).join(hubs, "a", "left")
    a_side = a_side.select("a", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = dealt.join(b_side, "b").join(a_side, ["a", "part"]).select("a", "b", "x", "y")
    out = stash(rows.mapInArrow(run, "a long, b long"), 500)
    discard(sets, hubs)
    return out


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of slices of the incidence matrix."""
    n = len(sets)
    items, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    held = times[where] > 1
    owner, place = owner[held], rank[where[held]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.diag([float(len(s)) for s in sets]).astype(np.float32) * 0
    for start in range(0, int((times > 1).sum()), columns):
        lo, hi = np.searchsorted(place, [start, start + columns])
        grid = np.zeros((n, columns), np.float32)
        grid[owner[lo:hi], place[lo:hi] - start] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def bridges(members: DataFrame, sets: DataFrame, percent: int, turn: int | None = None) -> DataFrame:
    """(a, b): labels to join, fewer for each cell than it has labels.

    members: key, id, label; sets: id, items. The members of a key are dealt into hashed blocks. With a turn, each block
    meets itself in a task, dealt anew for each turn. Without, those of the key's largest label are dealt apart from the
    rest, and each two blocks meet but for two of the largest label; so every pair of different labels is compared, but
    none is ever a row, and no task holds a whole hot key.
    """
    cell = ["key", "i", "j"]
    if turn is not None:
        blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        mine = F.pmod(F.xxhash64(F.lit(turn), "id"), F.col("blocks")).cast("int")
        rows = members.join(stash(blocks), "key").withColumn("mine", mine)
        rows = rows.select("key", F.col("mine").alias("i"), F.col("mine").alias("j"), "id", "label", "mine")
    else:
        counts = members.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
        counts = counts.agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("c"))
        shares = ((F.col("c") - F.col("m")) / BLOCK, F.col("m") / BLOCK)
        blocks = stash(counts.select("key", "main", *(F.ceil(x).cast("int").alias(n) for x, n in zip(shares, ("few", "many")))))
        dealt_to = F.when(
            F.col("label") == F.col("main"), F.col("few") + F.pmod(F.xxhash64("id"), F.col("many")).cast("int")
        ).otherwise(F.pmod(F.xxhash64("id"), F.col("few")).cast("int"))
        last = F.col("few") - 1 + F.when(F.col("label") == F.col("main"), 0).otherwise(F.col("many"))
        rows = (
            members.join(blocks, "key")
            .withColumn("mine", dealt_to)
            .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "label", "mine")
        )
    rows = stash(rows)
    full = rows.join(sets, "id").select(*cell, "id", "label", "mine", "items")

    def linked_in(part: pa.Table) -> pa.RecordBatch | None:
        n = part.num_rows
        names, labels = np.unique(part.column("label").to_numpy(), return_inverse=True)
        if n < 2 or labels.max() == 0:
            return None
        sets = [np.frombuffer(v, np.uint64) for v in part.column("items").to_pylist()]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        near &= labels[:, None] < labels[None, :]
        if part.column("i")[0] != part.column("j")[0]:
            mine = part.column("mine").to_numpy()
            near &= mine[:, None] != mine[None, :]
        p, q = np.nonzero(near)
        if not len(p):
            return None
        # of the links between labels only as many as join the same labels: a star for each component, no pairs
        count = len(names)
        beside = np.zeros((count, count), bool)
        beside[labels[p], labels[q]] = True
        beside |= beside.T
        root, left = np.arange(count), np.ones(count, bool)
        for k in range(count):
            if left[k]:
                wave = np.array([k])
                left[k] = False
                while len(wave):
                    root[wave] = k
                    wave = np.flatnonzero(beside[wave].any(axis=0) & left)
                    left[wave] = False
        far = np.flatnonzero(root != np.arange(count))
        return pa.RecordBatch.from_arrays([pa.array(names[root[far]]), pa.array(names[far])], names=["a", "b"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by cell; a cell that goes on into the next batch waits for it (2 x BLOCK rows or so)."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            marks = np.stack([table.column(c).to_numpy().astype(np.int64) for c in cell])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                if (out := linked_in(table.slice(a, b - a))) is not None:
                    yield out
            rest = table.slice(edges[-1])
        if rest is not None and (out := linked_in(rest)) is not None:
            yield out

    dealt = full.repartition(*cell).sortWithinPartitions(*cell)
    out = stash(dealt.mapInArrow(met, "a long, b long").distinct(), 500)
    discard(rows)
    return out


def still_open(members: DataFrame) -> DataFrame:
    """Those of members (key, id, label) whose key has several labels."""
    told = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    keys = stash(told.filter("low < high").select("key"))
    out = stash(members.join(keys, "key"))
    discard(keys)
    return out


def bridged(docs: DataFrame, members: DataFrame, where: DataFrame, percent: int, shingle: int) -> list[DataFrame]:
    """Tables of (a, b) that join the labels of members (key, id, label) as all links within their keys do.

    While a key has more than BLOCK members, its members meet in blocks first, dealt anew in each turn; what is joined
    gets one label, and keys with one label left are done. So a group whose members are often linked is one label after
    few turns, each of which takes every member once and makes fewer links than members. When a turn joins little, all
    remaining labels of a key meet exactly, the largest one's members only those of others.
    """
    found: list[DataFrame] = []
    sets = sets_of(docs, members.select("id").distinct().join(where, "id"), shingle)
    turn = 0
    while True:
        big = members.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK)
        some = stash(members.join(big.select("key"), "key", "left_semi"))
        n = some.count()
        if not n:
            discard(some)
            break
        new = bridges(some, sets, percent, turn)
        made = new.count()
        discard(some)
        found.append(new)
        if made:
            up = components(new)
            now = members.join(up.select(F.col("id").alias("label"), "component"), "label", "left")
            now = stash(now.select("key", "id", F.coalesce("component", "label").alias("label")))
            left = still_open(now)
            discard(members, up, now)
            members = left
        turn += 1
        if made < n / TURN_GAIN or turn == MOST_TURNS:
            break
    found.append(bridges(members, sets, percent))
    discard(members, sets)
    return found




def near_dedup(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Texts are lower-cased (A-Z) and cut into words; documents are linked when their sets of distinct `shingle`-word
    runs have 100 x intersection >= percent x union. A text with fewer words is one run; one without words, or null,
    has an empty set and is linked with nothing. component_id is the smallest id reachable by links.

    1. Equal sets fall into one class; only its smallest id goes on.
    2. Classes that share a band are candidates. Buckets are never expanded into pairs: first each member meets the
       smallest id of the bucket it shares most bands with, and these pairs are confirmed on full sets.
    3. Buckets that still hold several components are compared whole, in blocks, for links between components, again
       on full sets; large ones in random blocks first, while that joins much (see bridged). So every candidate pair is confirmed or lies within a component already.

    Rows are told apart by a number of their own and texts found again by their hash, so each row is a document, also
    where ids repeat or are null: links go through such rows too, and component_id is the smallest id of the component
    that is not null. A row with a null id is never kept; of repeated rows each is, if its id is the smallest. An empty
    table gives an empty result; further columns are ignored. A very long text takes time and memory in proportion to
    its length, and its set travels to a few of the blocks that it is compared in.
    """
    kind = dict(docs.dtypes)["doc_id"]
    told = stash(sketched(docs, shingle).withColumn("row", F.monotonically_increasing_id()))
    classes = told.filter("set_key is not null").groupBy("set_key")
    classes = stash(classes.agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")))
    reps = told.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    reps = stash(reps.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "k1", "k2", "keys"))
    where = reps.select("id", "k1", "k2")
    buckets = reps.select(F.explode("keys").alias("key"), "id", "n")
    shared = buckets.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("p")).filter("c > 1")
    shared = stash(shared.select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("m")))
    members = stash(buckets.join(shared, "key").distinct())
    discard(shared)

    def close(p: str, q: str):
        return 100 * F.least(p, q) >= percent * F.greatest(p, q)

    voted = members.filter("id != pivot").groupBy("id", "n", "pivot", "m").agg(F.count("*").alias("votes"))
    best = voted.groupBy("id", "n").agg(F.max_by(F.struct("pivot", "m"), F.struct("votes", "pivot")).alias("p"))
    best = best.select(F.col("p.pivot").alias("a"), F.col("id").alias("b"), "n", F.col("p.m").alias("m"))
    first = stash(best.filter(close("n", "m")).select("a", "b"))
    links = confirmed(docs, first, where, percent, shingle)
    labels = components(links)
    now = stash(
        members.join(labels.select("id", "component"), "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("label")
        )
    )
    discard(members, labels, first)
    open_keys = still_open(now)
    discard(now)
    more = bridged(docs, open_keys, where, percent, shingle)
    labels = components(reduce(DataFrame.union, more, links))
    discard(links, *more, reps)
    linked = classes.join(labels.withColumnRenamed("id", "rep"), "rep")
    lowest = stash(linked.groupBy("component").agg(F.min("least").alias("c")))
    rep_of = classes.join(linked.select("rep", "component"), "rep", "left").join(lowest, "component", "left")
    rep_of = stash(rep_of.select("set_key", F.coalesce("c", "least").alias("c")))
    discard(classes, labels, lowest)
    return told.join(rep_of, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("c", "doc_id").cast(kind).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.lit(False)).alias("kept"),
    )
