"""Which file depends on which: names that files import, files that the names stand for, and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.joins import joined

# A require, and one that holds no end of a line.
_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
_REQUIRE_IN_LINE = r"""require[ \t\f\x0B]*\([ \t\f\x0B]*['"][^'"\n\r\u0085\u2028\u2029]+['"][ \t\f\x0B]*\)"""
# An import word without a from in the rest of its line tells that none behind it has one: the rest is taken at once, for its
# requires (group 2), so that a long line is not searched again from each such word. It ends before what goes past the line.
_SCRIPT = rf"""import\s(?:.*?from\s+['"]([^'"]+)['"]|((?:{_REQUIRE_IN_LINE}|(?!{_REQUIRE}|import[\n\r]).)*+))|{_REQUIRE}"""
# What an import looks like, by extension (fixed values): pattern, groups (those that are not empty are names). An include that
# nothing closes tells that none behind it is closed, so the pattern goes to the end of the text at once.
IMPORTS = {
    (".c", ".cpp", ".cc", ".h", ".hpp", ".cxx"): (r"""#\s*include\s*[<"](?:([^>"]++)[>"]|[^>"]*+\z)""", (1,)),
    (".py",): (r"(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", (1, 2)),
    (".java",): (r"import\s+(?:static\s+)?([\w.]+);", (1,)),
    (".go",): (r'"([^"]+)"', (1,)),
    (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"): (_SCRIPT, (1, 4)),
    (".rs",): (r"(?:use\s+([\w:]+)|mod\s+(\w+))", (1, 2)),
}
# Languages whose module names are dotted paths (fixed values).
DOTTED = [".py", ".java"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^.](\.[^.]*)$", 1))


def imported(files: DataFrame) -> DataFrame:
    """path, name: the distinct names that each file (path, content) imports, wherever in it; dots become slashes where they are paths."""
    ext, text = extension(F.col("path")), F.col("content")
    cases = F.lit(None).cast("array<string>")
    for exts, (pattern, groups) in IMPORTS.items():
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
        if pattern == _SCRIPT:
            found += [F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda rest: F.regexp_extract_all(rest, F.lit(_REQUIRE), F.lit(1))))]
        names = F.concat(*found)
        names = F.transform(names, lambda n: F.replace(n, F.lit("."), F.lit("/"))) if set(exts) <= set(DOTTED) else names
        cases = F.when(ext.isin(*exts), F.array_distinct(names)).otherwise(cases)
    return files.select("path", F.explode(cases).alias("name")).filter("name <> ''")


def _stem(name: Column) -> Column:
    """Without its extension; a name that begins with its only dot keeps it."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def resolved(names: DataFrame, files: DataFrame) -> DataFrame:
    """name, target: the file (path) that a name stands for; names without one are left out.

    First by base name: the first path whose base name, or that without extension, is the name's last part, or whose
    stem is the whole name with dots for slashes. Else the first path whose stem ends with the name as a path. All
    whatever their case. Candidates are met by equal keys: base names, stems, and the suffixes of every path's stem, of
    any length in characters, that begin where the last parts of a name can.
    """
    told = names.select("name").distinct().withColumn("clean", F.lower(F.regexp_replace(F.trim("name"), ";+$", "")))
    base = F.substring_index("clean", "/", -1)
    keys = told.select("name", "clean", F.explode(F.array_distinct(F.array(base, F.replace("clean", F.lit("/"), F.lit("."))))).alias("key"), base.alias("base"))
    low = files.select("path", F.lower(F.substring_index("path", "/", -1)).alias("file"), F.lower("path").alias("low"))
    own = low.select("path", "file", _stem(F.col("file")).alias("stem"))
    own = own.select("path", "file", "stem", F.explode(F.array_distinct(F.array("file", "stem"))).alias("key"))
    hit = joined(keys, own, ["key"])
    hit = hit.filter((F.col("file") == F.col("base")) | (F.col("stem") == F.col("base")) | (F.col("stem") == F.replace("clean", F.lit("/"), F.lit("."))))
    first = hit.groupBy("name").agg(F.min("path").alias("target"))
    rest = joined(told, first, ["name"], "left_anti").withColumn("tail", F.replace(F.replace("clean", F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")))
    rest = rest.filter("tail <> ''").withColumn("last", F.substring_index("tail", "/", -1))
    # a path's stem ends with the name if its own last part ends with the name's last part: suffixes of that part are keys
    stems = low.select("path", _stem(F.col("low")).alias("stem")).withColumn("end", F.substring_index("stem", "/", -1))
    ends = stems.select("path", "stem", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("end"), F.lit(1))), lambda k: F.substring("end", k, F.length("end")))).alias("last"))
    whole = joined(rest, ends, ["last"]).filter(F.col("stem").endswith(F.col("tail"))).groupBy("name").agg(F.min("path").alias("target"))
    return first.unionByName(whole)


def edges(files: DataFrame) -> DataFrame:
    """src, dst: files and the project's files that they import, each once; a file's import of itself is left out."""
    names = imported(files)
    out = joined(names, resolved(names, files.select("path")), ["name"]).select(F.col("path").alias("src"), F.col("target").alias("dst"))
    return out.filter("src <> dst").distinct()


def reversed_edges(arcs: DataFrame) -> DataFrame:
    """From a file to those that import it: what a change of it reaches."""
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def scan_set(every: DataFrame, changed: DataFrame, cone: DataFrame) -> DataFrame:
    """path, why: changed files, and files that the change reaches (as affected), sorted by path at the reader's wish."""
    told = changed.select("path", F.lit("changed").alias("why")).distinct()
    reach = joined(cone.select(F.col("node").alias("path")), told, ["path"], "left_anti").withColumn("why", F.lit("affected"))
    return joined(told.unionByName(reach.distinct()), every.select("path").distinct(), ["path"], "left_semi")
