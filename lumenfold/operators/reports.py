"""Risk scores and machine-readable reports of findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base scores of severities (fixed values).
BASE = {"CRITICAL": 9.8, "HIGH": 8.0, "MEDIUM": 5.5, "LOW": 3.0, "INFO": 1.0}
#: Severity -> level of a SARIF result (fixed values); others are warnings.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def risk(severity: Column, sanitised: Column) -> Column:
    """The severity's base score (5 if it is unknown), three tenths of it where the flow is sanitised, to one digit."""
    base = F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in BASE.items()], F.lit(5.0))
    return F.bround(F.when(sanitised, base * 0.3).otherwise(base), 1)


def sarif_results(rows: DataFrame) -> DataFrame:
    """One JSON text (column value) for each finding, as a SARIF 2.1.0 result: a line at least 1, snippets of 300."""
    level = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in LEVELS.items()], F.lit("warning"))
    region = F.struct(
        F.greatest(F.coalesce(F.col("line").cast("int"), F.lit(1)), F.lit(1)).alias("startLine"),
        F.struct(F.left("snippet", F.lit(300)).alias("text")).alias("snippet"),
    )
    where = F.struct(
        F.struct(F.struct(F.col("path").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias(
            "physicalLocation"
        )
    )
    result = F.struct(F.col("issue").alias("ruleId"), level.alias("level"), F.array(where).alias("locations"))
    return rows.select("path", "line", "issue", F.to_json(result).alias("value"))


#: What a rule is known as in weakness lists, before what a dimension says (fixed values).
TAGS = {
    "buffer-overflow": "CWE-120", "stack-overflow": "CWE-121", "heap-overflow": "CWE-122", "use-after-free": "CWE-416",
    "double-free": "CWE-415", "null-pointer-deref": "CWE-476", "integer-overflow": "CWE-190", "format-string": "CWE-134",
    "sql-injection": "CWE-89", "os-command-injection": "CWE-78", "path-traversal": "CWE-22", "ssrf": "CWE-918",
    "xss": "CWE-79", "insecure-deserialization": "CWE-502", "hardcoded-password": "CWE-259", "weak-crypto": "CWE-327",
    "weak-rng": "CWE-338", "memory-leak": "CWE-401", "race-condition": "CWE-362", "insecure-eval": "CWE-95",
    "secret-in-code": "CWE-312", "vulnerable-dependency": "CWE-1395",
}
#: Ecosystem -> package address type (fixed values); others in lower case.
ADDRESSES = {"PyPI": "pypi", "npm": "npm", "crates.io": "cargo", "Go": "golang", "Maven": "maven", "NuGet": "nuget", "RubyGems": "gem"}


def title(issue: Column) -> Column:
    """A rule's name for people: blanks for dashes, each word with a capital."""
    return F.initcap(F.replace(issue, F.lit("-"), F.lit(" ")))


def sarif_documents(rows: DataFrame, intel: DataFrame, by: str, tool: str = "lumenfold", version: str = "1.0") -> DataFrame:
    """by, document: a whole SARIF 2.1.0 log for each value of `by`, from findings (path, line, issue, severity,
    confidence, note, snippet, and `by`) and what is known of issues (issue, cwe, cve, cvss, description, fix).

    A run names its rules once each, in order of first use, and lists results by path, line and issue. A document is
    built in one task, so `by` should split a large project (by file or folder).
    """
    known = rows.join(intel, "issue", "left")
    name = title(F.col("issue"))
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    tag = F.coalesce(F.element_at(tags, F.col("issue")), F.nullif("cwe", F.lit("")))
    rule = F.struct(
        F.col("issue").alias("id"),
        F.regexp_replace(name, "[^A-Za-z0-9]", "_").alias("name"),
        F.struct(name.alias("text")).alias("shortDescription"),
        F.struct(F.coalesce("description", name).alias("text")).alias("fullDescription"),
        F.struct(F.coalesce("fix", F.lit("Follow secure coding best practices.")).alias("text")).alias("help"),
        F.struct(
            F.filter(F.array(tag, F.nullif("cve", F.lit(""))), lambda t: t.isNotNull()).alias("tags"),
            F.lit("high").alias("precision"),
            F.col("cvss").cast("string").alias("security-severity"),
        ).alias("properties"),
    )
    level = F.coalesce(*[F.when(F.upper("severity") == k, F.lit(v)) for k, v in LEVELS.items()], F.lit("warning"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" \u2014 "), F.col("note"))).otherwise("")
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.struct(F.left("snippet", F.lit(300)).alias("text")))
    region = F.struct(
        F.greatest(F.coalesce(F.col("line").try_cast("int"), F.lit(1)), F.lit(1)).alias("startLine"), F.lit(1).alias("startColumn"), snippet.alias("snippet")
    )
    artifact = F.struct(F.replace(F.col("path").cast("string"), F.lit("\\"), F.lit("/")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    result = F.struct(
        F.col("issue").alias("ruleId"),
        level.alias("level"),
        F.struct(F.concat(name, F.lit(" detected (confidence: "), F.col("confidence"), F.lit(")"), note).alias("text")).alias("message"),
        F.array(F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct("severity", "confidence").alias("properties"),
    )
    told = known.select(F.col(by).alias("by"), F.struct("path", "line", "issue", rule.alias("rule"), result.alias("result")).alias("r"))
    every = told.groupBy("by").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    firsts = F.filter("rs", lambda r, i: F.array_position(F.transform(F.col("rs"), lambda x: x["issue"]), r["issue"]) == i + 1)
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform(firsts, lambda r: r["rule"]).alias("rules"), F.lit(version).alias("semanticVersion"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("rs", lambda r: r["result"]).alias("results"), F.lit("unicodeCodePoints").alias("columnKind"))
    document = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return every.select(F.col("by").alias(by), F.to_json(document).alias("document"))


def json_reports(rows: DataFrame, by: str, target: str = "", tool: str = "lumenfold") -> DataFrame:
    """by, document: a JSON report for each value of `by`: a summary (files, findings, counts by severity and stage) and
    the findings (path, line, issue, severity, confidence, stage, cwe, description, snippet, note) in order."""
    own = ["path", "line", "issue", "severity", "confidence", "stage", "cwe", "description", "snippet", "note"]
    found = F.array_sort(F.collect_list(F.struct(*[c for c in own if c in rows.columns]))).alias("findings")
    told = rows.groupBy(by).agg(found)

    def breakdown(name: str) -> Column:
        every = F.transform("findings", lambda f: f[name])
        one = lambda k: F.struct(k.alias("k"), F.size(F.filter(every, lambda x: x == k)).alias("n"))
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))), one))

    summary = F.struct(
        F.size(F.array_distinct(F.transform("findings", lambda f: f["path"]))).alias("files_scanned"), F.size("findings").alias("total_findings"),
        breakdown("severity").alias("severity_breakdown"), breakdown("stage").alias("stage_breakdown"),
    )
    document = F.struct(F.lit(tool).alias("tool"), F.lit(target).alias("target"), summary.alias("summary"), "findings")
    return told.select(by, F.to_json(document).alias("document"))


def unique_dependencies(deps: DataFrame) -> DataFrame:
    """One row for each name whatever its case, version and ecosystem: the first by source file and name."""
    key = [F.lower("name").alias("low"), "version", "ecosystem"]
    first = F.min(F.struct("source_file", "name")).alias("f")
    return deps.groupBy(*key).agg(first).select("f.name", "version", "ecosystem", "f.source_file")


def package_url(name: Column, version: Column, ecosystem: Column) -> Column:
    """pkg:type/name@version, the name in lower case with dashes for blanks; a Maven name's colon becomes a slash."""
    kinds = F.create_map(*[F.lit(x) for kv in ADDRESSES.items() for x in kv])
    kind = F.coalesce(F.element_at(kinds, ecosystem), F.lower(ecosystem))
    low = F.lower(F.replace(name, F.lit(" "), F.lit("-")))
    low = F.when(ecosystem == "Maven", F.regexp_replace(low, "^([^:]*):", "$1/")).otherwise(low)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), low, F.lit("@"), F.coalesce(version, F.lit("")))


def bill_of_materials(deps: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """name, version, ecosystem, value: one CycloneDX 1.4 component as JSON for each distinct (name, version, ecosystem,
    source_file); licences: (name, licence), the first of a name is told. Envelopes come from bill_head()."""
    once = unique_dependencies(deps)
    if licences is not None:
        once = once.join(licences.groupBy("name").agg(F.min("licence").alias("licence")), "name", "left")
    else:
        once = once.withColumn("licence", F.lit(None).cast("string"))
    ref = F.concat_ws("-", F.lower("ecosystem"), F.lower("name"), F.coalesce("version", F.lit("unknown")))
    part = F.struct(
        F.lit("library").alias("type"), "name", package_url(F.col("name"), F.col("version"), F.col("ecosystem")).alias("purl"), ref.alias("bom-ref"), "version",
        F.when(F.col("licence").isNotNull(), F.array(F.struct(F.struct(F.col("licence").alias("name")).alias("license")))).alias("licenses"),
        F.struct(F.array(F.struct(F.replace(F.col("source_file").cast("string"), F.lit("\\"), F.lit("/")).alias("location"))).alias("occurrences")).alias("evidence"),
    )
    return once.select("name", "version", "ecosystem", F.to_json(part).alias("value"))


def bill_of_vulnerabilities(found: DataFrame) -> DataFrame:
    """value: one CycloneDX vulnerability as JSON for each (name, version, ecosystem, cve, summary, severity, cvss, fixed)."""
    ref = F.concat_ws("-", F.lower("ecosystem"), F.lower("name"), F.coalesce("version", F.lit("unknown")))
    low = F.lower("severity")
    rating = F.struct(F.col("cvss").alias("score"), F.when(low.isin("critical", "high", "medium", "low"), low).otherwise("unknown").alias("severity"), F.lit("CVSSv3").alias("method"))
    versions = F.array(F.struct(F.coalesce("version", F.lit("unknown")).alias("version"), F.lit("affected").alias("status")))
    part = F.struct(
        F.concat_ws("-", F.lit("vuln"), "cve", "name").alias("bom-ref"), F.col("cve").alias("id"), F.col("summary").alias("description"), F.array(rating).alias("ratings"),
        F.array(F.struct(ref.alias("ref"), versions.alias("versions"))).alias("affects"),
        F.when(F.col("fixed").isNotNull(), F.concat(F.lit("Upgrade to "), "name", F.lit(" "), "fixed", F.lit(" or later."))).alias("recommendation"),
    )
    return found.select("name", "cve", F.to_json(part).alias("value"))


def bill_head(project: str, version: str, at: str, serial: str) -> str:
    """The envelope of a bill of materials without its two lists, as JSON."""
    component = {"type": "application", "name": project, "version": version, "bom-ref": f"root-{project}"}
    meta = {"timestamp": at, "tools": [{"name": "lumenfold"}], "component": component}
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.4", "serialNumber": f"urn:uuid:{serial}", "version": 1, "metadata": meta})


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows, and those old ones whose key is not among them."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
