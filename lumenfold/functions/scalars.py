"""Scalar rules on columns: severities, weakness ids, bands, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities by rank (fixed values).
RANKS = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


#: Other words for severities (fixed values).
ALIASES = {"CRIT": "CRITICAL", "HI": "HIGH", "MED": "MEDIUM", "INFORMATIONAL": "INFO", "INFORMATION": "INFO"}


def severity(told: Column, confidence: Column) -> Column:
    """The severity if it is one, by any of its names, else the confidence read as one, else MEDIUM."""
    names = F.create_map(*[F.lit(x) for kv in ({k: k for k in RANKS} | ALIASES).items() for x in kv])

    def known(c: Column) -> Column:
        return F.element_at(names, F.upper(F.trim(c)))

    return F.coalesce(known(told), known(confidence), F.lit("MEDIUM"))


def rank(sev: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in RANKS.items():
        out = F.when(sev == name, value).otherwise(out)
    return out


def weakness(told: Column) -> Column:
    """First digits as CWE-n, else empty."""
    digits = F.regexp_extract(F.coalesce(told, F.lit("")), r"([0-9]+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits)).otherwise("")


def band(cvss: Column) -> Column:
    return F.when(cvss >= 9, "CRITICAL").when(cvss >= 7, "HIGH").when(cvss >= 4, "MEDIUM").otherwise("LOW")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text.

    The characters are sorted once and runs are counted in one pass, so time is n log n in the text's length.
    """
    chars = F.array_sort(F.split(text, ""))
    n = F.length(text)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    part = lambda k: F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"].eqNullSafe(c)
        return F.struct(
            c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1).alias("run"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + part(acc["run"])).alias("sum"),
        )

    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + part(acc["run"]))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def confidence(told: Column, source_line: Column, sink_line: Column, snippet: Column) -> Column:
    """High, Medium or Low: one up where source and sink lines are known and differ, then one down for short snippets.

    A line of 0 is unknown; a null snippet counts as short; other words than these three count as Medium.
    """
    level = F.when(told == "High", 3).when(told == "Low", 1).otherwise(2)
    flows = (source_line != 0) & (sink_line != 0) & (source_line != sink_line)
    level = F.least(level + F.when(flows, 1).otherwise(0), F.lit(3))
    short = F.length(F.trim(F.coalesce(snippet, F.lit("")))) < 5
    level = F.greatest(level - F.when(short, 1).otherwise(0), F.lit(1))
    return F.when(level == 3, "High").when(level == 2, "Medium").otherwise("Low")
