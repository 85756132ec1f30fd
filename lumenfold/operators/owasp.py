"""Coverage of the ten categories of 2021: findings by weakness or word, with counts, shares and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories (fixed values): key, id, name.
CATEGORIES = [
    ("A01", "A01:2021", "Broken Access Control"),
    ("A02", "A02:2021", "Cryptographic Failures"),
    ("A03", "A03:2021", "Injection"),
    ("A04", "A04:2021", "Insecure Design"),
    ("A05", "A05:2021", "Security Misconfiguration"),
    ("A06", "A06:2021", "Vulnerable and Outdated Components"),
    ("A07", "A07:2021", "Identification and Authentication Failures"),
    ("A08", "A08:2021", "Software and Data Integrity Failures"),
    ("A09", "A09:2021", "Security Logging and Monitoring Failures"),
    ("A10", "A10:2021", "Server-Side Request Forgery"),
]

# Words of a finding's issue and description, the first contained one decides (fixed values, in this order).
WORDS = [
    ("path traversal", "A01"), ("directory traversal", "A01"), ("access control", "A01"), ("authorization", "A01"),
    ("privilege", "A01"), ("permission", "A01"), ("csrf", "A01"), ("cryptograph", "A02"), ("encryption", "A02"),
    ("weak hash", "A02"), ("weak crypto", "A02"), ("md5", "A02"), ("sha1", "A02"), ("des ", "A02"), ("random", "A02"),
    ("prng", "A02"), ("cleartext", "A02"), ("plaintext password", "A02"), ("injection", "A03"),
    ("sql injection", "A03"), ("command injection", "A03"), ("xss", "A03"), ("cross-site scripting", "A03"),
    ("buffer overflow", "A03"), ("stack overflow", "A03"), ("heap overflow", "A03"), ("format string", "A03"),
    ("use.after.free", "A03"), ("negative-index", "A03"), ("ring-buffer-overflow", "A03"),
    ("alloc-loop-mismatch", "A03"), ("uncapped-loop-bound", "A03"), ("le-loop-oob", "A03"),
    ("narrow-size-cast", "A03"), ("llvm-memcpy-param-size", "A03"), ("data-race", "A04"), ("off-by-one", "A03"),
    ("integer-truncation", "A03"), ("unsafe-block", "A04"), ("panic-unwrap", "A04"), ("double free", "A03"),
    ("null pointer", "A03"), ("out.of.bounds", "A03"), ("integer overflow", "A03"), ("memory corruption", "A03"),
    ("unsafe function", "A03"), ("dangerous function", "A03"), ("gets(", "A03"), ("strcpy", "A03"), ("sprintf", "A03"),
    ("eval(", "A03"), ("exec(", "A03"), ("os.system", "A03"), ("taint", "A03"), ("race condition", "A04"),
    ("toctou", "A04"), ("deadlock", "A04"), ("logic flaw", "A04"), ("business logic", "A04"),
    ("insecure design", "A04"), ("memory leak", "A04"), ("misconfiguration", "A05"), ("debug mode", "A05"),
    ("default password", "A05"), ("exposed port", "A05"), ("xxe", "A05"), ("cors", "A05"), ("docker", "A05"),
    ("terraform", "A05"), ("kubernetes", "A05"), ("iac ", "A05"), ("outdated", "A06"), ("vulnerable component", "A06"),
    ("known vulnerabilit", "A06"), ("cve-", "A06"), ("end.of.life", "A06"), ("eol", "A06"), ("dependency", "A06"),
    ("authentication", "A07"), ("hardcoded password", "A07"), ("hardcoded credential", "A07"),
    ("hard-coded password", "A07"), ("hard-coded credential", "A07"), ("hardcoded secret", "A07"),
    ("weak password", "A07"), ("brute force", "A07"), ("session fixation", "A07"), ("api.key", "A07"),
    ("secret.key", "A07"), ("deserialization", "A08"), ("pickle", "A08"), ("integrity", "A08"), ("supply.chain", "A08"),
    ("unsigned", "A08"), ("untrusted source", "A08"), ("logging", "A09"), ("monitoring", "A09"), ("audit trail", "A09"),
    ("log injection", "A09"), ("ssrf", "A10"), ("server.side request", "A10"),
]

_SEVERITIES = ["critical", "high", "medium", "low", "info"]


def by_word(issue: Column, description: Column) -> Column:
    """The category of the first word that issue and description contain, whatever their case; null if none."""
    text = F.lower(F.concat(F.coalesce(issue, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.coalesce(*[F.when(text.contains(w), F.lit(c)) for w, c in WORDS], F.lit(None).cast("string"))


def mapped(rows: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """rows (cwe, issue, description, ...) with category (null if none) and source (`cwe` where a weakness is told, else
    `keyword`). weaknesses: (weakness as CWE-n, category), a parameter, as such lists are long and change."""
    told = F.upper(F.trim("cwe"))
    told = F.when(told.startswith("CWE-"), told).otherwise(F.concat(F.lit("CWE-"), told))
    known = weaknesses.select(F.col("weakness").alias("__w"), F.col("category").alias("__c")).dropDuplicates(["__w"])
    out = rows.withColumn("__t", told).join(known, F.col("__t") == F.col("__w"), "left")
    category = F.coalesce("__c", by_word(F.col("issue"), F.col("description")))
    source = F.when(F.coalesce("cwe", F.lit("")) != "", "cwe").otherwise("keyword")
    return out.withColumns({"category": category, "source": source}).drop("__t", "__w", "__c")


def coverage(rows: DataFrame, order: list[str], samples: int = 3) -> DataFrame:
    """key, id, name, n, one count for each severity, samples (issue, severity, description of 120 characters; the first
    by `order`): one row for each of the ten categories, also those without findings, from rows with category."""
    spark = rows.sparkSession
    ten = spark.createDataFrame(CATEGORIES, "key string, id string, name string")
    counts = [F.count_if(F.lower("severity") == s).alias(s) for s in _SEVERITIES]
    told = rows.filter("category is not null")
    n = told.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *counts)
    w = Window.partitionBy("category").orderBy(*order)
    first = told.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= samples)
    shown = F.struct("nth", "issue", "severity", F.left("description", F.lit(120)).alias("description"))
    first = first.groupBy("category").agg(F.array_sort(F.collect_list(shown)).alias("samples"))
    out = ten.join(n, ten.key == n.category, "left").drop("category").join(first, ten.key == first.category, "left").drop("category")
    return out.na.fill(0, ["n", *_SEVERITIES])


def totals(rows: DataFrame) -> DataFrame:
    """total, mapped, unmapped, coverage_pct: a tenth for each category that has a finding."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("category").alias("mapped"), F.count_if(F.col("category").isNull()).alias("unmapped"),
        (F.countDistinct("category") * 10.0).alias("coverage_pct"),
    )
