"""Reports of other scanners as tables: path, line, issue, severity, message, tool.

Readers take (path, content), one report in a row, and parse it with built-in functions; a null, empty or broken report
has no findings. Tools' own names for issues become ours by the maps below; where a map has none, the tool's name stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tool ids -> issues (fixed values).
CPPCHECK = {
    "bufferAccessOutOfBounds": "heap-buffer-overflow", "bufferOverflow": "stack-buffer-overflow",
    "stackBufferOverflow": "stack-buffer-overflow", "heapBufferOverflow": "heap-buffer-overflow",
    "arrayIndexOutOfBounds": "stack-buffer-overflow", "outOfBounds": "heap-buffer-overflow",
    "writeOutsideBufferSize": "heap-buffer-overflow", "useAfterFree": "use-after-free", "doubleFree": "double-free",
    "memleakOnRealloc": "memory-leak", "memleak": "memory-leak", "resourceLeak": "memory-leak",
    "nullPointer": "null-pointer", "nullPointerRedundantCheck": "null-pointer", "integerOverflow": "integer-overflow",
    "signedIntegerOverflow": "integer-overflow", "unsignedIntegerOverflow": "integer-overflow",
    "integerOverflowCond": "integer-overflow", "divisionByZero": "division-by-zero",
    "invalidScanfArgType_int": "stack-buffer-overflow", "invalidScanfFormatWidth": "stack-buffer-overflow",
    "insecureRandSeed": "weak-rng", "prohibitedFunction": "stack-buffer-overflow", "uninitvar": "null-pointer",
    "danglingTempReference": "use-after-free", "autoVariables": "stack-buffer-overflow",
    "returnDanglingLifetime": "use-after-free",
}
# Check names, exact or as beginnings in this order (fixed values).
CLANG_TIDY = [
    ("clang-analyzer-security.insecureAPI.strcpy", "stack-buffer-overflow"),
    ("clang-analyzer-security.insecureAPI.gets", "stack-buffer-overflow"),
    ("clang-analyzer-security.insecureAPI.sprintf", "stack-buffer-overflow"),
    ("clang-analyzer-security.insecureAPI.scanf", "stack-buffer-overflow"),
    ("clang-analyzer-security.insecureAPI.strncat", "stack-buffer-overflow"),
    ("clang-analyzer-security.insecureAPI.vfork", "os-command-injection"),
    ("clang-analyzer-security.insecureAPI.mktemp", "insecure-temp-file"),
    ("clang-analyzer-security.insecureAPI.mkstemp", "insecure-temp-file"),
    ("clang-analyzer-security.insecureAPI.rand", "weak-rng"),
    ("clang-analyzer-alpha.security.ArrayBound", "stack-buffer-overflow"),
    ("clang-analyzer-cplusplus.NewDelete", "use-after-free"),
    ("clang-analyzer-cplusplus.NewDeleteLeaks", "memory-leak"),
    ("clang-analyzer-unix.Malloc", "heap-buffer-overflow"),
    ("clang-analyzer-unix.API", "heap-buffer-overflow"),
    ("clang-analyzer-core.NullDereference", "null-pointer"),
    ("clang-analyzer-core.DivideZero", "division-by-zero"),
    ("bugprone-integer-division", "integer-overflow"),
    ("bugprone-use-after-move", "use-after-free"),
    ("bugprone-infinite-loop", "off-by-one"),
    ("bugprone-too-small-loop-variable", "off-by-one"),
    ("bugprone-signed-char-misuse", "integer-overflow"),
    ("bugprone-misplaced-widening-cast", "integer-overflow"),
    ("cert-err34-c", "integer-overflow"),
    ("cert-str31-c", "stack-buffer-overflow"),
    ("cert-msc30-c", "weak-rng"),
    ("cert-msc50-cpp", "weak-rng"),
    ("cert-fio47-c", "stack-buffer-overflow"),
]
# Parts of rule ids, the first one contained wins (fixed values).
SEMGREP = [
    ("buffer-overflow", "buffer-overflow"), ("stack-buffer-overflow", "stack-buffer-overflow"),
    ("heap-buffer-overflow", "heap-buffer-overflow"), ("use-after-free", "use-after-free"),
    ("double-free", "double-free"), ("off-by-one", "off-by-one"), ("integer-overflow", "integer-overflow"),
    ("null-dereference", "null-pointer"), ("format-string", "format-string"),
    ("hardcoded-credential", "hardcoded-password"), ("hardcoded-secret", "hardcoded-password"),
    ("sql-injection", "sql-injection"), ("command-injection", "os-command-injection"),
    ("path-traversal", "path-traversal"), ("ssrf", "ssrf"), ("xss", "xss"), ("xxe", "xxe-injection"),
    ("insecure-deserialization", "insecure-deserialization"), ("weak-hash", "weak-crypto"),
    ("weak-crypto", "weak-crypto"), ("tls-verification", "insecure-tls"), ("race-condition", "race-condition"),
    ("use-of-goto", "stack-buffer-overflow"), ("dangerous-function", "stack-buffer-overflow"),
    ("eval", "insecure-eval"), ("pickle", "insecure-deserialization"), ("yaml-load", "insecure-deserialization"),
]
# Bug types (fixed values).
INFER = {
    "NULL_DEREFERENCE": "null-pointer", "USE_AFTER_FREE": "use-after-free", "DOUBLE_FREE": "double-free",
    "MEMORY_LEAK": "memory-leak", "BUFFER_OVERRUN_L1": "buffer-overflow", "BUFFER_OVERRUN_L2": "buffer-overflow",
    "BUFFER_OVERRUN_L3": "buffer-overflow", "BUFFER_OVERRUN_U5": "buffer-overflow",
    "INFERBO_ALLOC_MAY_BE_BIG": "integer-overflow", "INFERBO_ALLOC_IS_ZERO": "null-pointer",
    "INTEGER_OVERFLOW_L1": "integer-overflow", "INTEGER_OVERFLOW_L2": "integer-overflow",
    "INTEGER_OVERFLOW_U5": "integer-overflow", "PULSE_USE_AFTER_FREE": "use-after-free",
    "RESOURCE_LEAK": "memory-leak", "DIVIDE_BY_ZERO": "division-by-zero", "UNINITIALIZED_VALUE": "null-pointer",
}
# Test ids; any other is os-injection (fixed values).
BANDIT = {
    "B102": "os-injection", "B103": "os-injection", "B104": "os-injection", "B108": "insecure-temp-file",
    "B306": "insecure-temp-file", "B601": "os-command-injection", "B602": "os-command-injection",
    "B603": "os-command-injection", "B604": "os-command-injection", "B605": "os-command-injection",
    "B607": "os-command-injection", "B105": "hardcoded-password", "B106": "hardcoded-password",
    "B107": "hardcoded-password", "B301": "insecure-deserialization", "B302": "insecure-deserialization",
    "B303": "weak-crypto", "B304": "weak-crypto", "B305": "weak-crypto", "B324": "weak-crypto", "B307": "insecure-eval",
    "B322": "insecure-eval", "B311": "weak-rng", "B323": "insecure-tls", "B501": "insecure-tls", "B502": "insecure-tls",
    "B503": "insecure-tls", "B504": "insecure-tls", "B505": "weak-crypto", "B506": "insecure-deserialization",
    "B608": "sql-injection", "B101": "insecure-config", "B110": "insecure-config", "B404": "os-command-injection",
}
# Ids that say nothing about the code (fixed values).
NOISE = ["toomanyconfigs", "checkLibraryFunction", "checkLibraryNoReturn", "checkLibraryUseReturnValue"]
# A tool's severity -> ours; any other is MEDIUM (fixed values).
SEVERITIES = {"ERROR": "HIGH", "WARNING": "MEDIUM", "STYLE": "LOW", "PERFORMANCE": "LOW", "PORTABILITY": "LOW"}


def _named(names: dict[str, str], told: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), told)


def _first(names: list[tuple[str, str]], met: Column, how) -> Column:
    return F.coalesce(*[F.when(how(met, F.lit(k)), F.lit(v)) for k, v in names])


def cwe_in(message: Column) -> Column:
    """The first CWE-n that a text names, in capitals, else empty."""
    return F.upper(F.regexp_extract(F.coalesce(message, F.lit("")), r"(?i)(CWE-\d+)", 1))


def _canonical(rows: DataFrame, tool: str, mapped: Column) -> DataFrame:
    """rows: path, line, id, severity, message, ord."""
    return rows.select(
        "path", F.col("line").cast("int").alias("line"), F.coalesce(mapped, F.col("id")).alias("issue"),
        F.coalesce(_named(SEVERITIES, F.upper("severity")), F.lit("MEDIUM")).alias("severity"),
        F.col("message").alias("message"), cwe_in(F.col("message")).alias("cwe"), F.lit(tool).alias("tool"), "ord",
    )


def cppcheck(reports: DataFrame) -> DataFrame:
    """XML of version 2; the place is the first location, 0 if there is none; information and noise are left out."""
    error = "struct<_id:string,_severity:string,_msg:string,_cwe:string,location:array<struct<_file:string,_line:int>>>"
    told = reports.select("path", F.from_xml("content", f"errors struct<error:array<{error}>>", {"mode": "PERMISSIVE"}).alias("x"))
    rows = told.select("path", F.posexplode("x.errors.error").alias("ord", "e"))
    severity = F.coalesce("e._severity", F.lit("unknown"))
    message = F.coalesce("e._msg", F.lit("No message"))
    message = F.when(F.coalesce("e._cwe", F.lit("")) != "", F.concat(F.lit("[CWE-"), F.col("e._cwe"), F.lit("] "), message)).otherwise(message)
    place = F.get("e.location", F.lit(0))
    rows = rows.filter((severity != "information") & ~F.coalesce("e._id", F.lit("")).isin(*NOISE)).select(
        F.coalesce(place["_file"], F.col("path")).alias("path"), F.coalesce(place["_line"], F.lit(0)).alias("line"),
        F.coalesce("e._id", F.lit("")).alias("id"), severity.alias("severity"), message.alias("message"), "ord",
    )
    return _canonical(rows, "cppcheck", _named(CPPCHECK, F.col("id")))


def clang_tidy(reports: DataFrame) -> DataFrame:
    """Lines of `file:line:col: severity: message [check]`; compiler diagnostics are left out."""
    form = r"^([^:]+):(\d+):(\d+):\s+(error|warning|note):\s+(.+?)\s+\[([^\]]+)\]$"
    lines = reports.select(F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("ord", "text"))
    part = lambda k: F.regexp_extract("text", form, k)
    rows = lines.filter(F.col("text").rlike(form)).select(
        part(1).alias("path"), part(2).cast("int").alias("line"), part(6).alias("id"), part(4).alias("severity"), part(5).alias("message"), "ord"
    )
    rows = rows.filter(~F.col("id").startswith("clang-diagnostic-"))
    mapped = F.coalesce(_named(dict(CLANG_TIDY), F.col("id")), _first(CLANG_TIDY, F.col("id"), Column.startswith))
    return _canonical(rows, "clang-tidy", mapped)


def semgrep(reports: DataFrame) -> DataFrame:
    """JSON with `results`; messages of 200 characters at most. The path is the scanned file's, as of the report."""
    kind = "results array<struct<check_id:string,extra:struct<message:string,severity:string>,start:struct<line:int>>>"
    rows = reports.select("path", F.posexplode(F.from_json("content", kind)["results"]).alias("ord", "r")).select(
        "path", F.coalesce("r.start.line", F.lit(0)).alias("line"), F.coalesce("r.check_id", F.lit("semgrep")).alias("id"),
        F.coalesce("r.extra.severity", F.lit("warning")).alias("severity"),
        F.left(F.coalesce("r.extra.message", F.lit("")), F.lit(200)).alias("message"), "ord",
    )
    return _canonical(rows, "semgrep", _first(SEMGREP, F.lower("id"), Column.contains))


def infer(reports: DataFrame) -> DataFrame:
    """A JSON list of bugs; all are errors."""
    told = F.from_json("content", "array<struct<bug_type:string,line:int,qualifier:string>>")
    lists = reports.filter(F.col("content").rlike(r"^\s*\["))  # an object alone would be read as a list of one
    rows = lists.select("path", F.posexplode(told).alias("ord", "b")).filter("b is not null").select(
        "path", F.coalesce("b.line", F.lit(0)).alias("line"), F.coalesce("b.bug_type", F.lit("")).alias("id"), F.lit("error").alias("severity"),
        F.left(F.coalesce("b.qualifier", F.lit("")), F.lit(200)).alias("message"), "ord",
    )
    return _canonical(rows, "infer", _named(INFER, F.col("id")))


def bandit(reports: DataFrame) -> DataFrame:
    """path, line (null if not told), issue, snippet, message of JSON with `results`; of one issue on a line the first."""
    kind = "results array<struct<test_id:string,line_number:int,issue_text:string,code:string>>"
    rows = reports.select("path", F.posexplode(F.from_json("content", kind)["results"]).alias("ord", "r"))
    told = rows.select(
        "path", F.col("r.line_number").alias("line"), F.coalesce(_named(BANDIT, F.col("r.test_id")), F.lit("os-injection")).alias("issue"),
        F.regexp_replace(F.coalesce("r.code", F.lit("")), r"^\s+|\s+$", "").alias("snippet"), F.coalesce("r.issue_text", F.lit("")).alias("message"), "ord",
    )
    w = Window.partitionBy("path", "issue", "line").orderBy("ord")
    return told.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "ord")


def merged(tools: list[DataFrame]) -> DataFrame:
    """Findings of several tools for one file each (as path), the first of an issue on a line: tools in the given order,
    then as reported."""
    every = None
    for n, rows in enumerate(tools):
        rows = rows.withColumn("nth", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    w = Window.partitionBy("path", "issue", "line").orderBy("nth", "ord")
    return every.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "nth", "ord")


_PHYSICAL = "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>"
_PLACE = f"struct<physicalLocation:{_PHYSICAL},location:struct<physicalLocation:{_PHYSICAL}>>"
_RESULT = (
    "struct<kind:string,ruleId:string,properties:struct<cwe:string,tags:array<string>>,message:struct<text:string>,"
    "taxa:array<struct<id:string,toolComponent:struct<name:string>>>,"
    f"locations:array<{_PLACE}>,codeFlows:array<struct<threadFlows:array<struct<locations:array<{_PLACE}>>>>>>"
)


def sarif(reports: DataFrame) -> DataFrame:
    """suite (the report's path), cwe, file (base name), line of SARIF logs: the results of the first run that don't pass.

    The weakness is taken from the rule's id, else a property, the first tag, a taxon of CWE, or the message; places are
    the result's, else those of its first code flow. Rows without weakness, file or positive line are left out, and rows
    are distinct.
    """
    told = reports.select(F.col("path").alias("suite"), F.from_json("content", f"runs array<struct<results:array<{_RESULT}>>>").alias("s"))
    rows = told.select("suite", F.explode(F.get("s.runs", F.lit(0))["results"]).alias("r")).filter("r.kind is null or r.kind <> 'pass'")
    some = lambda c: F.nullif(c, F.lit(""))
    taxon = F.get(F.filter("r.taxa", lambda t: t["toolComponent"]["name"] == "CWE"), F.lit(0))["id"]
    named = F.coalesce(
        F.when(F.upper("r.ruleId").contains("CWE"), F.col("r.ruleId")), some(F.col("r.properties.cwe")), some(F.get("r.properties.tags", F.lit(0))),
        F.concat(F.lit("CWE-"), taxon), some(cwe_in(F.col("r.message.text"))),
    )
    digits = F.regexp_extract(F.coalesce(named, F.lit("")), r"(\d+)", 1)
    flow = F.get(F.get("r.codeFlows", F.lit(0))["threadFlows"], F.lit(0))["locations"]
    places = F.when(F.coalesce(F.size("r.locations"), F.lit(0)) > 0, F.col("r.locations")).otherwise(flow)
    out = rows.select("suite", digits.alias("digits"), F.explode(places).alias("p"))
    there = F.coalesce("p.physicalLocation", "p.location.physicalLocation")
    out = out.select("suite", F.concat(F.lit("CWE-"), "digits").alias("cwe"), F.substring_index(there["artifactLocation"]["uri"], "/", -1).alias("file"), there["region"]["startLine"].alias("line"), "digits")
    return out.filter("digits <> '' and file <> '' and line > 0").select("suite", "cwe", "file", "line").distinct()


def explained(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """suite, cwe, file, line, kind, got: each true finding as `match`, `mismatch` (one with another weakness stands at
    its place: the last by name) or `miss`, and each further prediction as `extra`."""
    at = ["suite", "file", "line"]
    here = pred.groupBy(*at).agg(F.collect_set("cwe").alias("told"))
    found = truth.join(here, at, "left")
    kind = F.when(F.array_contains("told", F.col("cwe")), "match").when(F.col("told").isNotNull(), "mismatch").otherwise("miss")
    got = F.when(kind == "mismatch", F.array_max("told"))
    out = found.select("suite", "cwe", "file", "line", kind.alias("kind"), got.alias("got"))
    extra = pred.join(truth, ["suite", "cwe", "file", "line"], "left_anti").select("suite", "cwe", "file", "line", F.lit("extra").alias("kind"), F.lit(None).cast("string").alias("got"))
    return out.unionByName(extra)
