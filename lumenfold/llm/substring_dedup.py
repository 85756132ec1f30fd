"""Repeated passages by seed and extend: winnowed anchors, extension both ways, removal of maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, stash, text_keys
from lumenfold.llm.shingles import hashes, mixed, runs, words

#: Words of a repeat at least, and of an anchor.
WINDOW, ANCHOR = 35, 8
#: Texts whose 16-byte keys are sent to every executor to pick them during the scan; beyond, a shuffle joins them.
BROADCAST_KEYS = 500_000


def anchored(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the anchor-word runs, for each window the place of its anchor: the leftmost least run in it).

    Equal windows have their anchor at the same place within them, so each repeat has an anchor in common.
    """
    grams = runs(h, anchor)
    n = len(h) - window + 1
    if n < 1:
        return grams, np.empty(0, np.intp)
    width = window - anchor + 1
    at = np.empty(n, np.intp)
    for start in range(0, n, 50_000):  # the view is as large as the width times this
        stop = min(n, start + 50_000)
        view = np.lib.stride_tricks.sliding_window_view(grams[start : stop + width - 1], width)
        at[start:stop] = view.argmin(axis=1) + np.arange(start, stop)
    return grams, at


def window_hashes(grams: np.ndarray, n: int, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """A hash of each window, from the hashes of the runs that cover it."""
    acc = np.zeros(n, np.uint64)
    for k in [*range(0, window - anchor, anchor), window - anchor]:
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + grams[k : k + n])
    return acc


def covered(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that starts at one of starts: the union of the maximal repeats."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def seeded(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, k1, k2 (of the text), n_words, text_key (same for the same words), whole_sha256, anchors (hash, twice
    if it repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, digests, anchors = [], [], [], []
            for text in batch.column(3):
                found = words(text.as_py())
                line = b" ".join(found)
                grams, at = anchored(hashes(found), window, anchor)
                own, times = np.unique(grams[np.unique(at)], return_counts=True)
                counts.append(len(found))
                keys.append(xxhash.xxh3_128_digest(line))
                digests.append(hashlib.sha256(line).hexdigest())
                anchors.append(np.repeat(own, np.minimum(times, 2)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(digests, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n_words", "text_key", "whole_sha256", "anchors"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, k1 long, k2 long, n_words long, text_key binary, whole_sha256 string, anchors array<bigint>"
    return docs.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(run, schema)


def picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of each row of wanted (k1, k2 and more), once; the texts are picked during the scan if few."""
    rows = docs.select("text", *text_keys(F.col("text")))
    keys = wanted.select("k1", "k2")
    if keys.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    return rows.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])


def extended(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """row, start, whole, seed: the windows around the anchors that a document shares, each by its hash.

    A window belongs to one anchor; extending a shared anchor both ways gives the windows that belong to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, seeds in zip(*batch.columns, strict=True):
                h = hashes(words(text.as_py()))
                grams, at = anchored(h, window, anchor)
                shared = np.frombuffer(seeds.values.buffers()[1], np.int64)[
                    seeds.values.offset : seeds.values.offset + len(seeds.values)
                ].view(np.uint64)
                starts = np.flatnonzero(np.isin(grams[at], shared))
                whole = window_hashes(grams, len(at), window, anchor)[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), row.as_py(), np.int64)),
                        pa.array(starts, pa.int32()),
                        pa.array(whole.view(np.int64)),
                        pa.array((grams[at][starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    ],
                    names=["row", "start", "whole", "seed"],
                )

    return rows.select("row", "text", "seeds").mapInArrow(run, "row long, start int, whole long, seed int")


def trimmed(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """row, n_removed, kept_sha256 (and kept_text) of texts with the starts of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                removed, digests, texts = [], [], []
                for text, starts in zip(part.column(1), part.column(2), strict=True):
                    found = words(text.as_py())
                    gone = covered(len(found), np.array(starts.as_py(), np.int64), window)
                    line = b" ".join(w for w, g in zip(found, gone.tolist(), strict=True) if not g)
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(line).hexdigest())
                    texts.append(line.decode())
                columns = [part.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                if with_text:
                    columns.append(pa.array(texts, pa.string()))
                names = ["row", "n_removed", "kept_sha256", "kept_text"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.select("row", "text", "starts").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    Every word covered by a run of `window` words that also starts anywhere else, in another document or the same
    one, is removed; runs are judged on the input. kept_sha256 is of the kept words joined by one space.

    1. Documents with the same words form one class: all their windows repeat; one row stands for all below.
    2. Anchors, winnowed so that each window has one, are counted; those that occur once go (seed).
    3. The windows around shared anchors are hashed (96 bits with the seed) and counted over the whole corpus
       (extend); a hot anchor gives as many rows as it has windows, never pairs. Those that occur once go.
    4. Each document's repeated windows are joined into maximal repeats and cut out.

    Rows are told apart by a number of their own and texts found again by their hash, so null ids and ids that several
    rows share change nothing: each row is a document. Null, empty and short texts lose nothing; repeated rows lose all
    from `window` words on, as each repeats the other. An empty table gives an empty result; further columns are ignored.
    A very long text takes time and memory in proportion to its length.
    """
    told = stash(seeded(docs, window, anchor).withColumn("row", F.monotonically_increasing_id()))
    classes = told.groupBy("text_key").agg(F.min(F.struct("row", "k1", "k2")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stash(classes.select("text_key", "rep.*", "copies"))
    reps = told.filter(f"n_words >= {int(window)}").join(classes.select("row"), "row", "left_semi")
    seeds = reps.select("row", F.explode("anchors").alias("seed"))
    shared = stash(seeds.groupBy("seed").count().filter("count > 1").select("seed"))
    wanted = seeds.distinct().join(shared, "seed").groupBy("row").agg(F.collect_list("seed").alias("seeds"))
    wanted = stash(wanted.join(classes.select("row", "k1", "k2"), "row"))
    windows = stash(extended(picked(docs, wanted), window, anchor))
    discard(shared, wanted)
    repeated = stash(windows.groupBy("whole", "seed").count().filter("count > 1").select("whole", "seed"))
    single = classes.filter("copies = 1").select("row", "k1", "k2")
    starts = windows.join(repeated, ["whole", "seed"]).groupBy("row").agg(F.collect_list("start").alias("starts"))
    starts = stash(starts.join(single, "row"))
    discard(windows, repeated)
    cut = stash(trimmed(picked(docs, starts), window, False))
    discard(starts)
    copied = stash(classes.filter("copies > 1").select("text_key"))
    discard(classes)
    gone = F.col("copied") & (F.col("n_words") >= window)
    return (
        told.drop("anchors")
        .join(copied.withColumn("copied", F.lit(True)), "text_key", "left")
        .join(cut, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.sha2(F.lit("").cast("binary"), 256))
            .otherwise(F.coalesce("kept_sha256", "whole_sha256"))
            .alias("kept_sha256"),
        )
    )
