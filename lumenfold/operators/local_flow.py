"""Taint within a function: sources name variables, assignments carry them on, guards cover lines, sinks take them.

Functions are windows of a file from a line with an opening brace to the one that closes it. All of a function's work
happens in arrays of its own row, so nothing is shuffled; a window's size bounds a row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.scan import matches, plain, stripped

# Patterns whose group names a tainted variable; then guards; then sinks with what they cause (fixed values).
SOURCES = [
    r"(?:char|wchar_t)\s*\*\s*(\w+)\s*=\s*argv\s*\[",
    r"\bgets\s*\(\s*(\w+)\s*\)",
    r"\b(?:scanf|sscanf|fscanf)\s*\([^,]+,\s*&?\s*(\w+)",
    r"\bfgets\s*\(\s*(\w+)\s*,",
    r"\bread\s*\(\s*\w+,\s*(\w+)\s*,",
    r"\brecv(?:from)?\s*\(\s*\w+,\s*(\w+)\s*,",
    r"(?:char|const char)\s*\*\s*(\w+)\s*=\s*getenv\s*\(",
    r"\b(?:int|long|size_t)\s+(\w+)\s*=\s*(?:atoi|atol|strtol|strtoul)\s*\(",
]
GUARDS = [
    r"if\s*\([^)]*(?:>|>=|<|<=)\s*(?:sizeof|MAX_|max_|BUF_SIZE|BUFSIZ|MAXLEN)[^)]*\)",
    r"if\s*\([^)]*(?:==|!=)\s*NULL[^)]*\)",
    r"\bif\s*\([^)]*strlen\s*\([^)]+\)\s*[<>]=?\s*",
    r"\bstd::min\s*\(",
    r"\bstd::clamp\s*\(",
    r"\bassert\s*\([^)]*(?:<=|<)\s*sizeof",
    r"\bif\s*\([^)]*>=\s*MAX_",
    r"\bif\s*\([^)]*>\s*\w*[Mm]ax\w*[^)]*\)\s*(?:return|break|continue|throw)",
    r"\bif\s*\([^)]*\w+\s*>\s*[A-Z_]+_MAX",
    r"size_checked|bounds_check|validate_size|check_len",
]
SINKS = [
    (r"\bstrcpy\s*\(\s*\w+\s*,\s*(\w+)\s*\)", "stack-buffer-overflow"),
    (r"\bstrcat\s*\(\s*\w+\s*,\s*(\w+)\s*\)", "stack-buffer-overflow"),
    (r"\bsprintf\s*\(\s*\w+\s*,\s*(\w+)", "format-string"),
    (r"\bmemcpy\s*\(\s*\w+\s*,\s*\w+\s*,\s*(\w+)\s*\)", "heap-buffer-overflow"),
    (r"\bmemset\s*\(\s*\w+\s*,\s*\w+\s*,\s*(\w+)\s*\)", "heap-buffer-overflow"),
    (r"\w+\s*\[\s*(\w+)\s*\]", "negative-index"),
    (r"\b(?:malloc|calloc|realloc)\s*\(\s*(\w+)", "integer-overflow"),
    (r"\b(?:system|popen)\s*\(\s*(\w+)\s*[,)]", "os-command-injection"),
    (r"\bprintf\s*\(\s*(\w+)\s*[,)]", "format-string"),
    (r"\bfopen\s*\(\s*(\w+)\s*,", "path-traversal"),
]
ASSIGNED = r"(?m)(?:char|uint8_t|uint32_t|uint64_t|int|size_t|void|auto)?\s*\*?\s*(\w+)\s*=\s*(\w+)\s*[;,)]"
GRAVE = ["stack-buffer-overflow", "heap-buffer-overflow", "os-command-injection", "format-string"]
NOT_NAMES = ["NULL", "nullptr", "0"]
#: Lines that a guard covers, with its own; passes over the assignments; lines of a window at most (fixed values).
REACH, PASSES, LONGEST = 12, 5, 800

_WINDOWS = "array<struct<start:int,body:string>>"


def windows(content: Column) -> Column:
    """Functions of a file: array of (start, body). A window opens at a line with `{` where none is open and closes after
    a later line that brings the depth to 0; one that does not within LONGEST lines is given up at the file's end or there."""
    lines = F.split(plain(content), "\n")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.lit(0).alias("depth"), none.alias("held"), F.array().cast(_WINDOWS).alias("out"))
    count = lambda line, sign: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))

    def step(acc: Column, line: Column) -> Column:
        at = acc["at"] + 1
        inside = acc["from"] > 0
        opens = ~inside & line.contains("{")
        depth = F.when(inside | opens, acc["depth"] + count(line, "{") - count(line, "}")).otherwise(0)
        held = F.when(inside | opens, F.concat(acc["held"], F.array(line))).otherwise(none)
        closes = inside & (depth == 0)
        drops = inside & ~closes & (at - acc["from"] >= LONGEST - 1)
        done = F.array(F.struct(acc["from"].alias("start"), F.array_join(held, "\n").alias("body")))
        ends = closes | drops
        return F.struct(
            at.alias("at"), F.when(ends, 0).when(opens, at).otherwise(acc["from"]).alias("from"), F.when(ends, 0).otherwise(depth).alias("depth"),
            F.when(ends, none).otherwise(held).alias("held"), F.when(closes, F.concat(acc["out"], done)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def functions(files: DataFrame) -> DataFrame:
    """path, start, body of each function window."""
    return files.select("path", F.explode_outer(windows(F.col("content"))).alias("w")).filter("w is not null").select("path", "w.*")


def tainted(body: Column) -> Column:
    """Names that sources taint, and those that take their value over at most PASSES passes of single assignments."""
    seeds = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in SOURCES])))
    seeds = F.filter(seeds, lambda n: ~n.isin(*NOT_NAMES))
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(ASSIGNED), F.lit(1)).alias("to"), F.regexp_extract_all(body, F.lit(ASSIGNED), F.lit(2)).alias("of"))

    def once(known: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, known, lambda names, p: F.when(F.array_contains(names, p["of"]) & ~F.array_contains(names, p["to"]), F.concat(names, F.array(p["to"]))).otherwise(names))

    def closed(known: Column) -> Column:
        every = F.transform(F.array(pairs), lambda ps: F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), known, lambda names, _: once(names, ps)))
        return F.when(F.size(known) > 0, F.flatten(every)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(seeds), closed))  # arrays of one bind what is used several times


def flows(files: DataFrame) -> DataFrame:
    """path, line, issue, confidence, variable, snippet: sinks that take a tainted variable and that no guard covers; of one
    issue on a line the first sink's."""
    told = functions(files).select("path", "start", "body", tainted(F.col("body")).alias("names"))
    guards = F.flatten(F.array(*[F.transform(matches(F.col("body"), p), lambda m: m["line"]) for p in GUARDS]))
    sinks = []
    for pattern, issue in SINKS:
        sinks.append(F.transform(matches(F.col("body"), pattern, 1), _mark_sink(issue)))
    rows = told.select("path", "start", "body", "names", F.when(F.size("names") > 0, guards).alias("guards"), F.posexplode_outer(F.when(F.size("names") > 0, F.flatten(F.array(*sinks)))).alias("at", "s")).filter("s is not null")
    covered = F.exists("guards", lambda g: (F.col("s.line") >= g) & (F.col("s.line") < g + REACH))
    rows = rows.filter(F.array_contains("names", F.col("s.held")) & ~covered)
    first = rows.groupBy("path", "start", "s.line", "s.issue").agg(F.min_by(F.struct(F.col("s.held").alias("variable"), F.get(F.split("body", "\n"), F.col("s.line") - 1).alias("text")), F.col("at")).alias("f"))
    line = (F.col("start") + F.col("line") - 1).alias("line")
    sure = F.when(F.col("issue").isin(*GRAVE), "HIGH").otherwise("MEDIUM").alias("confidence")
    return first.select("path", line, "issue", sure, "f.variable", stripped(F.col("f.text")).alias("snippet"))


def _mark_sink(issue: str):
    return lambda m: F.struct(m["line"].alias("line"), F.lit(issue).alias("issue"), m["held"].alias("held"))
