"""What several of the operators share: written intermediate tables, words, components of link graphs."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the white space that separates words (Java syntax).
SPACE = r"\x20\x09-\x0D"

_written: list[tuple[SparkSession, str]] = []
_batch_size = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; where the session names none, one of our own if all run on this
    machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    arrow_rows bounds the rows of a batch sent to Python meanwhile, for rows that are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold/{uuid.uuid4().hex}"
    if arrow_rows:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        with _batch_size:  # one writer at a time may change what the session holds
            before = spark.conf.get(key)
            try:
                spark.conf.set(key, arrow_rows)
                df.write.parquet(path)
            finally:
                spark.conf.set(key, before)
    else:
        df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stash() wrote and that nothing reads any more."""
    for df in tables:
        path = df._stash_path
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def placed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), file and place: the hashed name of the file that a row stands in (without what a writer
    draws at random), and where in it. Rows that come from no file are numbered and written."""
    row = F.struct(*docs.columns).alias("row")
    try:
        where = docs.metadataColumn("_metadata")
        name = F.regexp_replace(where["file_name"], "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
        return docs.select(row, F.xxhash64(name).alias("file"), where["row_index"].alias("place"))
    except AnalysisException:
        return stash(docs.select(row, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place")))


def text_keys(text: Column) -> tuple[Column, Column]:
    """k1, k2: 128 bits of a text's hash, null as empty, by which a second scan finds the same texts again."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the session may be gone already
                return


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): each linked id with the smallest id it reaches.

    Minimum labels go over the links and are then short-cut through the label's own label, so the rounds
    follow the logarithm of the longest chain. Each round is written to the shared folder; nothing but a count
    comes to the driver. Every join reads two plain tables, so that a hub with very many links can be split.
    """
    both = stash(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = stash(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("component")))
    while True:
        told = both.join(labels, both.u == labels.id).select(F.col("v").alias("id"), "component")
        told = told.withColumn("before", F.lit(None).cast(dict(labels.dtypes)["component"]))
        own = labels.select("id", "component", F.col("component").alias("before"))
        # each id's own label comes along as `before`, so that no further join is needed to see what has changed
        least = stash(
            told.union(own).groupBy("id").agg(F.min("component").alias("component"), F.max("before").alias("before"))
        )
        up = least.select(F.col("id").alias("component"), F.col("component").alias("above"))
        moved = stash(
            least.join(up, "component").select("id", F.least("component", "above").alias("component"), "before")
        )
        settled = moved.filter(F.col("component") != F.col("before")).isEmpty()
        discard(labels)
        discard(least)
        if settled:
            discard(both)
            out = moved.drop("before")
            out._stash_path = moved._stash_path
            return out
        labels = moved
