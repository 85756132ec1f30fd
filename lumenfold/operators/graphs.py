"""Reachability over edges by semi-naive rounds."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.joins import joined


def checkpoints(spark: SparkSession) -> str:
    """The shared folder of checkpoints; where the session names none, one of our own if all run on this machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenfold-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cone(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, depth: all that is reached from the seeds along src -> dst, in as many rounds as the longest of the
    shortest paths has steps. Only the last round's nodes are joined again, and each round is checkpointed, so plans
    stay short; cycles end because known nodes are dropped."""
    checkpoints(edges.sparkSession)
    # edges are made once, not in each round; checkpoints keep what is inferred of their columns, but through a generator
    # nothing is, so plans don't grow by round
    edges = edges.select("src", "dst").checkpoint().select(F.inline(F.array(F.struct("src", "dst"))))
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    last = seen
    for depth in itertools.count(1):
        step = joined(last.withColumnRenamed("node", "src"), edges, ["src"]).select(F.col("dst").alias("node")).distinct()
        last = joined(step, seen, ["node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if last.isEmpty():
            return seen
        seen = seen.union(last).checkpoint()
