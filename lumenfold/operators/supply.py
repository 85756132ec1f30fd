"""Dependencies: licences, base images, package addresses, known snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.matching import first_match

# Licences that ask for review, in the order in which they are looked for, with their risk (fixed values).
RISKS = [("AGPL", "HIGH"), ("GPL-3", "HIGH"), ("GPL-2", "HIGH"), ("SSPL", "HIGH"), ("LGPL", "MEDIUM"), ("MPL", "MEDIUM"), ("EUPL", "MEDIUM"), ("CDDL", "MEDIUM")]
RISKY = [name for name, _ in RISKS]
# Files that tell a folder's licence, in this order, and what is looked for in their first 512 characters (fixed values).
LICENCE_FILES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING", "COPYING.txt"]
COPYLEFT = r"(?i)(AGPL|GPL-[23]|GPL v[23]|General Public License|LGPL|MPL|SSPL|EUPL|CDDL)"


def licence_risk(told: Column) -> Column:
    """The first risky licence that the text names, else empty."""
    return first_match(F.upper(told), [(x, x) for x in RISKY], "contains")


def base_image(image: Column) -> dict[str, Column]:
    """base (last part of the path, without tag), tag (latest if none), pinned (by digest), major (base:major)."""
    plain = F.regexp_replace(image, r"@sha256:.*$", "")
    last = F.substring_index(plain, "/", -1)
    base = F.substring_index(last, ":", 1)
    tag = F.when(last.contains(":"), F.substring_index(last, ":", -1)).otherwise("latest")
    return {
        "base": base,
        "tag": tag,
        "pinned": image.contains("@sha256:"),
        "major": F.concat(base, F.lit(":"), F.substring_index(tag, ".", 1)),
    }


def end_of_life(image: Column, ended: list[str]) -> Column:
    """Whether the image's full tag or its major version is in the list."""
    p = base_image(image)
    return F.concat(p["base"], F.lit(":"), p["tag"]).isin(*ended) | p["major"].isin(*ended)


def package_address(kind: str, name: Column, version: Column) -> Column:
    return F.concat(F.lit(f"pkg:{kind}/"), F.lower(name), F.when(version.isNotNull(), F.concat(F.lit("@"), version)).otherwise(""))


def known_snippets(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (path, content) whose digest begins with one of the registry (prefix of 16 digits, origin)."""
    told = files.select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("prefix"))
    return told.join(registry, "prefix")


def cvss(scores: Column) -> Column:
    """The highest number that ends one of the texts, after the last slash of a vector or alone; 0 if there is none."""
    number = F.transform(scores, lambda s: F.regexp_extract(F.coalesce(s, F.lit("")), r"(\d+\.\d+)\s*$", 1).try_cast("double"))
    return F.coalesce(F.array_max(number), F.lit(0.0))


def fixed_version(affected: Column, package: Column) -> Column:
    """The first version of `fixed` in the entries (name, fixed array) of the package, whatever its case; else null."""
    own = F.filter(affected, lambda a: F.lower(a["name"]) == F.lower(package))
    every = F.flatten(F.transform(own, lambda a: F.coalesce(a["fixed"], F.array().cast("array<string>"))))
    return F.get(F.filter(every, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def licensed(deps: DataFrame, files: DataFrame) -> DataFrame:
    """deps (name, version, source_file, licence) with licence from the folder's licence files (path, content) where none
    is told, and with risk and matched (the licence that asks for review; both null if none does)."""
    name = F.substring_index("path", "/", -1)
    found = F.nullif(F.regexp_extract(F.left("content", F.lit(512)), COPYLEFT, 1), F.lit(""))
    rank = F.array_position(F.array(*map(F.lit, LICENCE_FILES)), name)
    own = files.filter(name.isin(*LICENCE_FILES)).select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("folder"), rank.alias("rank"), found.alias("found"))
    own = own.filter("found is not null").groupBy("folder").agg(F.min_by("found", "rank").alias("found"))
    told = deps.withColumn("folder", F.regexp_extract("source_file", r"^(.*?)/?[^/]*$", 1)).join(own, "folder", "left")
    told = told.withColumn("licence", F.coalesce(F.nullif("licence", F.lit("")), "found")).drop("found", "folder")
    matched = F.coalesce(*[F.when(F.upper("licence").contains(k), F.lit(k)) for k, _ in RISKS])
    risk = F.coalesce(*[F.when(F.upper("licence").contains(k), F.lit(v)) for k, v in RISKS])
    return told.withColumns({"matched": matched, "risk": risk})


def advised(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """name, version, ecosystem, cve, summary, severity, cvss, fixed of each pinned dependency's advisories (ecosystem,
    name, version, id, aliases, summary, scores, affected): a table in place of a service. Names are equal whatever their
    case; the CVE is the first alias that is one, else the id; severity is the score's band."""
    from lumenfold.functions.scalars import band

    told = advisories.withColumnsRenamed({"name": "__name", "version": "__version", "ecosystem": "__ecosystem"})
    on = (F.lower("name") == F.lower("__name")) & (F.col("version") == F.col("__version")) & (F.col("ecosystem") == F.col("__ecosystem"))
    rows = deps.filter("version is not null").join(told, on)
    cve = F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(0))
    top = cvss(F.col("scores"))
    return rows.select(
        "name", "version", "ecosystem", F.coalesce(cve, "id").alias("cve"), F.coalesce("summary", F.lit("No description available.")).alias("summary"),
        band(top).alias("severity"), top.alias("cvss"), fixed_version(F.col("affected"), F.col("name")).alias("fixed"),
    )
