"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the original vectors."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import components, discard, stash

#: Vectors of the bounded sample that the rotations are learned on, and rounds of learning.
SAMPLE, ROUNDS = 4000, 30
#: Of the links planted beside the sample, just at the threshold, the tables miss this share at most.
MISS = 0.005
#: Sampled vectors beside which links are planted.
PLANTED = 1000
#: Vectors of a bucket that meet in one task; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Buckets aim at so many vectors.
BUCKET = 48
#: Comparing a row with so many others costs about as much as moving it into one more table.
MATES = 256
#: Up to so many tables are made without asking whether comparing all pairs is cheaper.
MOST_TABLES = 64
#: Rotations that the plan may use: the code is as long as these times the dimension at most.
MOST_TURNS = 64

_log = logging.getLogger(__name__)


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A rotation that brings the centred sample close to the corners of the cube.

    It starts from a random one; in turn the codes are the signs of the rotated sample and the rotation is the
    orthogonal one that carries the sample closest to its codes (Procrustes).
    """
    d = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds if len(sample) else 0):
        codes = np.where(sample @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(sample.T @ codes)
        turn = u @ v
    return turn


class Coder:
    """Vectors -> long binary codes: signs of the centred, rotated vector against each bit's median over the sample, so
    that a bit splits the sample in halves. Rotations beyond the first are learned when the plan asks for more bits."""

    def __init__(self, sample: np.ndarray, dim: int):
        self.dim, self.sample = dim, sample
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        self.turns: list[np.ndarray] = []
        self.middle: list[np.ndarray] = []

    def grow(self, turns: int) -> None:
        centred = self.sample - self.centre
        while len(self.turns) < turns:
            turn = learn_rotation(centred, 7 + len(self.turns))
            self.turns.append(turn)
            self.middle.append(np.median(centred @ turn, axis=0) if len(centred) else np.zeros(self.dim))

    def bits(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        turns = list(zip(self.turns, self.middle, strict=True))[first:last]
        return np.concatenate([(x - self.centre) @ t >= m for t, m in turns], axis=1)

    def keys(self, x: np.ndarray, width: int, tables: int) -> np.ndarray:
        """rows x tables: substrings of `width` bits of the code, as numbers."""
        if not width:
            return np.zeros((len(x), tables), np.int32)
        per_turn = self.dim // width
        signs = self.bits(x, 0, -(-tables // per_turn))
        cut = [r * self.dim + k * width for r in range(-(-tables // per_turn)) for k in range(per_turn)][:tables]
        weights = 1 << np.arange(width, dtype=np.int64)
        return np.stack([signs[:, c : c + width] @ weights for c in cut], axis=1).astype(np.int32)


def planted(sample: np.ndarray, cosine: float, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at exactly this cosine: sampled directions with a partner in a random direction, and with one on the way
    to another sampled vector (which stays where the data lie, also if they fill few dimensions)."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:PLANTED]]
    out = []
    for off in (rng.standard_normal(x.shape), x[rng.permutation(len(x))] - x):
        off = off - (off * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(off, axis=1)
        held = size > 1e-6
        y = cosine * x[held] + math.sqrt(1 - cosine**2) * off[held] / size[held, None]
        if len(y):
            out.append((x[held], y))
    return out


def plan(coder: Coder, per_label: float, cosine: float) -> tuple[int, int, int, float]:
    """(bits of a table's key, radius, tables, recall measured on planted links).

    Keys grow with the logarithm of the rows, as buckets should stay small. A table finds a link whose keys differ in
    `radius` bits at most: 0, or 1 by probing the neighbouring keys, which costs half a key's bits more copies of each
    row but needs fewer tables; where angles are wide that is cheaper. For each width and radius tables are added, and
    rotations learned, until the planted links that no table finds are MISS of them at most; the cheapest wins. Where
    it takes over MOST_TABLES and is dearer than all pairs, or none suffices, all rows of a label meet (0 bits).
    """
    every = 1 + per_label / MATES
    pairs = planted(coder.sample, cosine) if len(coder.sample) > 1 else []
    top = int(min(coder.dim, 24, max(6, math.ceil(math.log2(max(2.0, per_label / BUCKET))) + 2)))
    limit = max(MOST_TABLES, every)
    best: tuple[float, int, int, int, float] | None = None
    differ: list[list[np.ndarray]] = [[] for _ in pairs]
    for width in range(top, min(top, 6) - 1, -1) if pairs else ():
        for radius in (0, 1):
            moves = (1 + radius * width / 2) + per_label / 2**width * (1 + radius * width) / MATES
            missed = [np.ones(len(x), bool) for x, _ in pairs]
            per_turn, tables, done = coder.dim // width, 0, False
            while not done and tables < min(limit, per_turn * MOST_TURNS) and (best is None or (tables + 1) * moves < best[0]):
                turn, k = divmod(tables, per_turn)
                coder.grow(turn + 1)
                for told, (x, y) in zip(differ, pairs, strict=True):
                    if len(told) <= turn:
                        told.append(coder.bits(x, turn, turn + 1) != coder.bits(y, turn, turn + 1))
                for miss, told in zip(missed, differ, strict=True):
                    miss &= told[turn][:, k * width : (k + 1) * width].sum(axis=1) > radius
                tables += 1
                done = all(miss.mean() <= MISS for miss in missed)
            if done:
                best = tables * moves, width, radius, tables, 1 - max(float(miss.mean()) for miss in missed)
    if best is None or (best[3] > MOST_TABLES and best[0] > every):
        return 0, 0, 1, 1.0
    return best[1:]


def usable(column: pa.Array, flat: type) -> list[bytes | None]:
    """Each vector's components as they are stored; None for null, empty and zero vectors, null or non-finite components."""
    out: list[bytes | None] = [None] * len(column)
    start = column.offsets.to_numpy()
    sizes = np.diff(start)
    values = column.values.to_numpy(zero_copy_only=False)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[there & (sizes > 0)]).tolist():
        rows = np.flatnonzero(there & (sizes == size))
        x = values[start[rows][:, None] + np.arange(size)].astype(flat)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        for k, v in zip(rows[good].tolist(), x[good], strict=True):
            out[k] = v.tobytes()
    return out


def _directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _met_before(p: np.ndarray, q: np.ndarray, radius: int) -> np.ndarray:
    apart = p ^ q
    return (apart == 0) | ((apart & (apart - 1)) == 0 if radius else False)


def compare(x: np.ndarray, keys: np.ndarray, t: int, radius: int, apart: np.ndarray | None, cosine: float) -> np.ndarray:
    """Links within a cell, each in the first table that brings its two rows together; apart: pairs that may count."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if apart is not None:
        near &= apart
    if near.sum() < len(x) * 4:
        p, q = np.nonzero(np.triu(near))
        if len(p) and t:
            gone = _met_before(keys[p, :t], keys[q, :t], radius).any(axis=1)
            near[p[gone], q[gone]] = near[q[gone], p[gone]] = False
    else:
        for earlier in range(t):
            near &= ~_met_before(keys[:, None, earlier], keys[None, :, earlier], radius)
    return near


def joined(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a block reaches over the block's links: a star for each of its components."""
    order = np.argsort(ids, kind="stable")
    near = near[order][:, order]
    root, left = np.arange(len(ids)), np.ones(len(ids), bool)
    for k in range(len(ids)):
        if left[k]:
            wave = np.array([k])
            left[k] = False
            while len(wave):
                root[wave] = k
                wave = np.flatnonzero(near[wave].any(axis=0) & left)
                left[wave] = False
    out = np.empty_like(ids)
    out[order] = ids[order][root]
    return out


def links_of(
    reps: DataFrame, dim: int, flat: type, label_kind: str, cosine: float, planned: tuple[int, int, int] | None
) -> tuple[DataFrame, float | None]:
    """(row, links, least) of reps (row, vector, label, copies), vectors of `dim` components, and the recall planned for.

    With dim 0 lengths are mixed and not coded: those of one label and length all meet.
    """
    size = np.dtype(flat).itemsize
    counts = reps.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    picked = reps.orderBy(F.xxhash64("row"), "row").limit(SAMPLE if dim else 0)
    sample = np.frombuffer(b"".join(r[0] for r in picked.select("vector").collect()), flat).reshape(-1, max(1, dim))
    coder = Coder(_directions(sample) if len(sample) else np.empty((0, dim)), dim)
    bits, radius, tables, recall = (0, 0, 1, None) if not dim else (*planned, None) if planned else plan(coder, counts["n"] / max(1, counts["labels"]), cosine)
    if planned and bits:
        coder.grow(-(-tables // (dim // bits)))
    _log.info("%s vectors: %s tables of %s bits, radius %s, recall of planted links %s", counts["n"], tables, bits, radius, recall)
    coder.sample = coder.sample[:0]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys = np.empty((len(raw), tables), np.int32)
            lengths = np.array([len(v) for v in raw], np.int64)
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                if n == dim * size:
                    x = np.frombuffer(b"".join(raw[k] for k in own.tolist()), flat).reshape(len(own), -1)
                    keys[own] = coder.keys(_directions(x), bits, tables)
                else:  # without a code: one bucket for each length
                    keys[own] = -n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))],
                names=["row", "vector", "label", "copies", "code", "keys"],
            )

    codes = stash(reps.mapInArrow(coded, f"row long, vector binary, label {label_kind}, copies long, code binary, keys array<int>"))
    own = "struct(key, false AS guest)"
    places = f"array({own})"
    if radius and bits:
        zeros = f"filter(sequence(0, {bits - 1}), i -> key >= 0 AND (key & shiftleft(1, i)) = 0)"
        places = f"concat(array({own}), transform({zeros}, i -> struct(key | shiftleft(1, i) AS key, true AS guest)))"
    bucket = ["label", "t", "key"]

    def placed(*more: str) -> DataFrame:
        told = codes.select("label", *more, F.posexplode("keys").alias("t", "key"))
        return told.select("label", "t", *more, F.explode(F.expr(places)).alias("p")).select(*bucket[:2], *more, "p.key", "p.guest")

    sizes = placed().groupBy(*bucket).agg(F.count_if("guest").alias("g"), F.count("*").alias("n"))
    whole = F.col("n") <= BLOCK
    sizes = stash(
        sizes.filter("g < n and n > 1").select(
            *bucket,
            F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("g")) / BLOCK)).cast("int").alias("hosts"),
            F.when(whole, 0).otherwise(F.ceil(F.col("g") / BLOCK)).cast("int").alias("guests"),
        )
    )
    cell = ["lab", "t", "key", "i", "j"]
    seat = F.xxhash64("row")
    mine = F.when(F.col("guest") & (F.col("guests") > 0), F.col("hosts") + F.pmod(seat, F.col("guests"))).otherwise(F.pmod(seat, F.col("hosts")))
    last = F.col("hosts") - 1 + F.when(F.col("guest"), 0).otherwise(F.col("guests"))
    cells = (
        placed("row", "vector", "copies", "code")
        .join(sizes, bucket)
        .withColumn("mine", mine.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(
            F.xxhash64("label").alias("lab"), "t", "key", F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"), "row", "vector", "copies", "code", "mine", "guest",
        )
    )

    def linked_in(part: pa.Table) -> pa.RecordBatch | None:
        n = part.num_rows
        raw = part.column("vector").to_pylist()
        if n < 2 or len({len(v) for v in raw}) > 1:
            return None
        x = _directions(np.frombuffer(b"".join(raw), flat).reshape(n, -1))
        keys = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int32).reshape(n, -1)
        guest = part.column("guest").to_numpy()
        apart = ~(guest[:, None] & guest[None, :]) if guest.any() else None
        if part.column("i")[0] != part.column("j")[0]:
            own = part.column("mine").to_numpy()
            across = own[:, None] != own[None, :]
            apart = across if apart is None else apart & across
        near = compare(x, keys, part.column("t")[0].as_py(), radius, apart, cosine)
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return None
        ids, near = part.column("row").to_numpy()[hit], near[hit][:, hit]
        links = near @ part.column("copies").to_numpy()[hit]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(joined(near, ids))], names=["row", "links", "least"])

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

    dealt = cells.repartition(*cell).sortWithinPartitions(*cell)
    told = stash(dealt.mapInArrow(met, "row long, links long, least long"))
    discard(sizes, codes)
    return told, recall


def embedding_dedup(vectors: DataFrame, cosine: float = 0.93, planned: tuple[int, int, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept, index_recall for each row of (vec_id, embedding, label).

    Rows with equal, non-null labels are linked if their cosine, in double precision, is at least `cosine`. Vectors
    that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing; so do
    vectors of different lengths. n_links counts the other rows linked directly; component_id is the smallest id
    reachable by links.

    1. Rows with one label and the same vector form a class; one of them goes on and counts for all, so that a vector
       that is repeated without end costs one row.
    2. For each length of vectors with a hundredth of the rows, rotations are learned on a bounded sample (rarer lengths
       have one bucket each); every class is coded. The code is cut into substrings, one for each
       table; classes of a label meet in a table's bucket if they agree in its substring, or, with radius 1, if one of
       them differs in one bit and visits. How many tables that takes is measured (see plan); index_recall is the share
       of links planted at the threshold that they find, the same on each row, and is logged.
    3. In a bucket the original vectors are compared, in blocks; a pair counts in the first table that brings it
       together. Pairs never leave the block: each row gets a number of links and the smallest row that it reaches over
       the block's links. Buckets of more than BLOCK rows are dealt out as pairs of hashed blocks.

    Rows are told apart by a number of their own: repeated rows and rows with one id and other vectors count each by
    itself; a null id links like any other but is never a component's id, if others are, and never kept. An empty table
    gives an empty result, further columns are ignored. planned (bits, radius, tables) overrides the plan.
    """
    id_kind, label_kind = dict(vectors.dtypes)["vec_id"], dict(vectors.dtypes)["label"]
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    flat = np.float32 if kind == "float" else np.float64
    size = np.dtype(flat).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array(usable(batch.column(2), flat), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["vec_id", "label", "vector"])

    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(read, f"vec_id {id_kind}, label {label_kind}, vector binary")
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector")))
    rows = stash(rows.select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2")))
    of = ["label", "v1", "v2"]
    classes = rows.filter("vector is not null").groupBy(*of)
    classes = stash(classes.agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    reps = stash(rows.select("row", "vector").join(classes.select("row", "label", "copies"), "row"))
    # lengths that hold a hundredth of the rows get a plan of their own, 100 at most; the rest meet by their length
    width = (F.octet_length("vector") / size).cast("int")
    every = stash(reps.groupBy(width.alias("dim")).count())
    n = every.agg(F.sum("count")).first()[0] or 0
    dims = [r.dim for r in every.filter(F.col("count") * 100 >= n).orderBy("dim").collect()]
    parts = [links_of(reps.filter(width == d), d, flat, label_kind, cosine, planned) for d in dims]
    if every.count() > len(dims):
        parts.append(links_of(reps.filter(~width.isin(dims)), 0, flat, label_kind, cosine, None))
    told = reduce(DataFrame.union, [t for t, _ in parts]) if parts else reps.sparkSession.createDataFrame([], "row long, links long, least long")
    recall = min((r for _, r in parts if r is not None), default=None)
    discard(every, reps)
    n_links = told.groupBy("row").agg(F.sum("links").alias("links"))
    labels = components(told.select(F.col("row").alias("a"), F.col("least").alias("b")).distinct())
    linked = classes.select("row", F.col("least").alias("first")).join(labels.withColumnRenamed("id", "row"), "row")
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = linked.select("row", "component").join(lowest, "component").select("row", "lowest")
    told_of = classes.join(n_links, "row", "left").join(linked, "row", "left")
    told_of = stash(told_of.select(*of, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("lowest", "least").alias("component")))
    discard(labels, classes, *(t for t, _ in parts))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", *of).join(told_of, of, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(recall).cast("double").alias("index_recall"),
    )
