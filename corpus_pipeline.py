"""A corpus from raw documents to tokens: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as
Parquet to the shared folder and read again. All but the last return the columns of documents, whatever further ones
there are. Copies are dropped row by row, by the place that a row has in its file: of fully repeated rows one stays, and
rows with a null id are copies like others, but give way to rows with an id. Null and empty texts are copies of each
other for exact dedup, so one of them stays; near dedup links them with nothing, the mix takes none of them. Every stage
gives an empty result for an empty table, and reads very long texts whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from lumenfold.llm.common import stash

#: Dropped rows whose places (16 bytes each) go to every executor; more are dropped by a shuffled anti-join.
BROADCAST_ROWS = 500_000


def _placed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), file and place: where each row stands in its file."""

    def told(rows: DataFrame) -> DataFrame:
        where = rows.metadataColumn("_metadata")
        row = F.struct(*rows.columns).alias("row")
        return rows.select(row, F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("place"))

    try:
        return told(docs)
    except AnalysisException:  # not read from files
        return told(stash(docs))


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that judge (doc_id, text -> doc_id, kept) keeps; there each row has an id of its own, in the
    order of the documents' ids, nulls last, and of their places."""
    rows = _placed(docs)
    own = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "file", "place")
    told = judge(rows.select(own.alias("doc_id"), F.col("row.text").alias("text")))
    gone = stash(told.filter("not kept").select("doc_id.file", "doc_id.place"))
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, ["file", "place"], "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled rows that are not held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the longest as it is written, then the smallest id."""
    return _kept(docs, exact_dedup.exact_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return _kept(docs, near_dedup.near_dedup)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it; its copies stand one behind the other."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that the mix took, once for each copy; copies in a row are encoded once."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_docs(docs, vocabulary, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier, the sketches' check and the encoder have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
