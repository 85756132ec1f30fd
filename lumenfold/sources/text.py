"""Texts as lines, and manifests as dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.scan import stripped


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line (from 1), text; CRLF and CR count as LF; null content has no lines."""
    plain = F.regexp_replace(F.col(content), "\r\n?", "\n")
    out = files.select(F.col(path).alias("path"), F.posexplode(F.split(plain, "\n")).alias("at", "text"))
    return out.select("path", (F.col("at") + 1).alias("line"), "text")


def code_files(spark, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, ext, content, sha256, size of the files under root with one of the suffixes; folders of tools are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    skipped = F.col("path").rlike(r"/(\.git|node_modules|__pycache__|\.venv|venv)/")
    return raw.filter(ext.isin(*suffixes) & ~skipped).select(
        "path",
        ext.alias("ext"),
        F.make_valid_utf8(F.decode("content", F.lit("UTF-8"))).alias("content"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size"),
    )


def requirements(rows: DataFrame) -> DataFrame:
    """(path, line, text) of requirement files -> name, version (null if none), source_file.

    Lines that begin with a hash, a dash (options) or a dot (local folders) hold no package. The version is what follows
    the first run of comparison signs, up to white space, a semicolon, a comma or a hash.
    """
    text = stripped(F.col("text"))
    found = r"^([A-Za-z0-9_.\-]+)\s*(?:[=~!<>]+\s*([^\s;,#]+))?"
    told = rows.filter(~text.rlike(r"^[#.\-]")).select(
        F.col("path").alias("source_file"), F.regexp_extract(text, found, 1).alias("name"), F.regexp_extract(text, found, 2).alias("version")
    )
    return told.filter("name <> ''").withColumn("version", F.expr("nullif(version, '')"))
