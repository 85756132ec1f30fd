"""Which findings to believe: marks of test and generated code, suppression, a linear score; and fixes for known lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import confidence
from lumenfold.operators.joins import joined
from lumenfold.operators.scan import stripped

# What names of test files, test functions and generated files look like (fixed values).
TEST_FILE = r"(?i)(?:^|/)(?:tests?|specs?|__tests__|test_|_test\b|spec_|_spec\b)|(?:^|/)conftest\.py$|(?:_test|_spec|Test|Spec)\.[a-z]+$"
TEST_FUNCTION = r"^(?:test_|spec_|it_|describe_|should_|setUp|tearDown|before|after|Test[A-Z]|Spec[A-Z]|test[A-Z])"
GENERATED = r"(?i)auto[-_]?generated|machine[-_]?generated|DO NOT (?:EDIT|MODIFY)|generated by|code[-_]?gen|protobuf|thrift"

# Scores of issues, confidences and stages, what others get, and the weights of all features (fixed values).
ISSUES = {
    "stack-buffer-overflow": 1.0, "heap-buffer-overflow": 1.0, "os-command-injection": 1.0, "format-string": 0.9,
    "use-after-free": 0.9, "double-free": 0.9, "race-condition": 0.8, "data-race": 0.8, "integer-overflow": 0.75,
    "integer-truncation": 0.7, "negative-index": 0.7, "off-by-one": 0.65, "sql-injection": 0.9, "path-traversal": 0.8,
    "null-pointer-deref": 0.6, "uninitialized-variable": 0.5, "volatile-misuse": 0.7, "missing-atomic": 0.6,
    "double-checked-locking": 0.8, "thread-in-destructor": 0.75, "concurrent-map-write": 0.8,
    "goroutine-loop-closure": 0.85, "potential-stack-overflow": 0.4, "waitgroup-add-in-goroutine": 0.8,
}
CONFIDENCES = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
STAGES = {
    "AST": 0.5, "Taint": 0.7, "Deep": 0.75, "Dataflow": 0.8, "Interprocedural": 0.85, "Symbolic": 0.9,
    "Concurrency": 0.8, "LLVM": 0.9, "Concolic": 0.95, "StaticTool": 0.6,
}
UNSAFE = ["strcpy", "strcat", "gets", "sprintf", "system", "memcpy"]
OTHERS = {"issue": 0.4, "confidence": 0.3, "stage": 0.5}
WEIGHTS = {
    "issue": 0.30, "confidence": 0.20, "stage": 0.15, "line": 0.02, "snippet": 0.03, "note": 0.05, "cve": 0.08,
    "interprocedural": 0.07, "unsafe": 0.07,
}
LEAST_SCORE = 0.35


def test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def test_function(name: Column) -> Column:
    return name.rlike(TEST_FUNCTION)


def generated_file(path: Column, head: Column) -> Column:
    """By its name, or by the first 500 characters of its first lines."""
    return F.substring_index(path, "/", -1).rlike(GENERATED) | F.coalesce(F.left(head, F.lit(500)).rlike(GENERATED), F.lit(False))


def triaged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with confidence changed, and reason (null where a finding survives).

    rows: path, issue, line, snippet, confidence, source_line, sink_line, head (first lines of the file), dead (in code
    that never runs), guarded (a sanitiser dominates it), function (that holds it; null if none). In turn: repeats of
    (path, issue, line) in `order` are duplicates; findings in test files fall to Low; those in generated files, dead
    code or behind a guard go; those in test functions fall to Low; then confidence is adjusted.
    """
    w = Window.partitionBy("path", "issue", "line").orderBy(*order)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.row_number().over(w) > 1, "duplicate")
        .when(generated_file(F.col("path"), F.col("head")), "generated_code")
        .when(no("dead"), "dead_code")
        .when(no("guarded"), "sanitizer_dominates")
    )
    low = test_file(F.col("path")) | F.coalesce(test_function(F.col("function")), F.lit(False))
    told = F.when(low, F.lit("Low")).otherwise(F.col("confidence"))
    sure = confidence(told, F.coalesce("source_line", F.lit(0)), F.coalesce("sink_line", F.lit(0)), F.col("snippet"))
    return rows.withColumns({"reason": reason, "confidence": sure})


def _scored(names: dict[str, float], told: Column, other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), told), F.lit(other))


def score(issue: Column, sure: Column, stage: Column, line: Column, snippet: Column, note: Column) -> Column:
    """The weighted sum of what a finding tells of itself, between 0 and 1."""
    text, said = F.coalesce(snippet, F.lit("")), F.coalesce(note, F.lit(""))
    unsafe = F.lit(False)
    for name in UNSAFE:
        unsafe = unsafe | text.contains(name)
    features = {
        "issue": _scored(ISSUES, issue, OTHERS["issue"]),
        "confidence": _scored(CONFIDENCES, F.upper(sure), OTHERS["confidence"]),
        "stage": _scored(STAGES, stage, OTHERS["stage"]),
        "line": F.least(F.lit(1.0), F.coalesce(line, F.lit(1)) / 5000.0),
        "snippet": F.least(F.lit(1.0), F.length(text) / 200.0),
        "note": F.least(F.lit(1.0), F.length(said) / 500.0),
        "cve": said.contains("CVE-").cast("double"),
        "interprocedural": F.coalesce((stage == "Interprocedural").cast("double"), F.lit(0.0)),
        "unsafe": unsafe.cast("double"),
    }
    total = sum((F.lit(WEIGHTS[k]) * v for k, v in features.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def likely(rows: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Findings of high confidence, and others whose score is high enough; with their score."""
    told = score(*(F.col(c) for c in ("issue", "confidence", "stage", "line", "snippet", "note")))
    return rows.withColumn("score", told).filter((F.upper("confidence") == "HIGH") | (F.col("score") >= least))


# Fixes by language and issue: patterns in order, what stands in their place, and how sure that is (fixed values).
FIXES = {
    "c": {
        "stack-buffer-overflow": [(r"(\s*)gets\s*\(\s*(\w+)\s*\)\s*;", "$1fgets($2, sizeof($2), stdin);", "High")],
        "buffer-overflow": [(r"(\s*)strcpy\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)\s*;", "$1strncpy($2, $3, sizeof($2) - 1);\n$1$2[sizeof($2) - 1] = '\\\\0';", "High")],
        "heap-buffer-overflow": [(r'(\s*)sprintf\s*\(\s*(\w+)\s*,\s*(".*?")\s*,\s*(.*?)\s*\)\s*;', "$1snprintf($2, sizeof($2), $3, $4);", "High")],
        "format-string": [(r"(\s*)printf\s*\(\s*(\w+)\s*\)\s*;", '$1printf("%s", $2);', "High")],
        "weak-rng": [(r"(\s*)(\w+)\s*=\s*rand\s*\(\s*\)\s*;", "$1$2 = arc4random();", "Medium")],
    },
    "python": {
        "os-command-injection": [
            (r"(\s*)os\.system\s*\(\s*(.+?)\s*\)", "$1subprocess.run($2, shell=False, check=True)", "High"),
            (r"(\s*)subprocess\.(?:call|run|Popen)\s*\(\s*(.+?),\s*shell\s*=\s*True", "$1subprocess.run($2, shell=False", "High"),
        ],
        "insecure-eval": [(r"(\s*)eval\s*\(\s*(.+?)\s*\)", "$1ast.literal_eval($2)", "High")],
        "insecure-deserialization": [(r"(\s*)pickle\.loads?\s*\(\s*(.+?)\s*\)", "$1json.loads($2)", "Medium")],
        "weak-crypto": [(r"(\s*)hashlib\.md5\s*\(", "$1hashlib.sha256(", "High"), (r"(\s*)hashlib\.sha1\s*\(", "$1hashlib.sha256(", "High")],
        "hardcoded-password": [(r"""(\s*)(password|secret|api_key|token)\s*=\s*["'][^"']{4,}["']""", '$1$2 = os.environ.get("$2", "")', "Medium")],
    },
    "go": {"insecure-tls": [(r"(\s*)InsecureSkipVerify\s*:\s*true", "$1InsecureSkipVerify: false", "High")]},
    "java": {"weak-crypto": [(r'(\s*)getInstance\s*\(\s*"(?:MD5|SHA1|DES|RC4)"\s*\)', '$1getInstance("SHA-256")', "High")]},
}


def fixes(found: DataFrame, lines: DataFrame, kind: Column, table: dict = FIXES) -> DataFrame:
    """path, line, issue, original, fixed, confidence of findings (path, line, issue) whose line (path, line, text) a fix
    of its language and issue changes: the first pattern that fits replaces all that it fits on the line."""
    told = joined(found.select("path", "line", "issue").distinct(), lines.select("path", "line", "text"), ["path", "line"])
    done = F.lit(None).cast("struct<fixed:string,confidence:string>")
    for language, issues in table.items():
        for issue, patterns in issues.items():
            cases = F.lit(None).cast("struct<fixed:string,confidence:string>")
            for pattern, to, sure in reversed(patterns):
                cases = F.when(F.col("text").rlike(pattern), F.struct(F.regexp_replace("text", pattern, to).alias("fixed"), F.lit(sure).alias("confidence"))).otherwise(cases)
            done = F.when((kind == language) & (F.col("issue") == issue), cases).otherwise(done)
    out = told.withColumn("d", done).filter("d is not null and d.fixed <> text")
    end = lambda c: F.regexp_replace(c, r"\s+$", "")
    return out.select("path", "line", "issue", end(F.col("text")).alias("original"), end(F.col("d.fixed")).alias("fixed"), "d.confidence")


def applied(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """The lines (path, line, text) with fixed ones in place; of several fixes of a line the first by issue."""
    first = changes.groupBy("path", "line").agg(F.min(F.struct("issue", "fixed")).alias("f"))
    return joined(lines, first, ["path", "line"], "left").select("path", "line", F.coalesce("f.fixed", "text").alias("text"))


def patches(changes: DataFrame) -> DataFrame:
    """path, line, patch: each change as one hunk of a unified diff without context."""
    name = F.substring_index("path", "/", -1)
    mark = lambda sign, c: F.concat(F.lit(sign), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + sign)))
    count = F.size(F.split("fixed", "\n"))
    size = F.when(count > 1, F.concat(F.lit(","), count)).otherwise("")
    head = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), "line", F.lit(" +"), "line", size, F.lit(" @@\n"))
    return changes.select("path", "line", F.concat(head, mark("-", "original"), F.lit("\n"), mark("+", "fixed"), F.lit("\n")).alias("patch"))


def hinted(found: DataFrame, remedies: DataFrame, most: int) -> DataFrame:
    """issue, first_path, hint: the first `most` issues, by the first file that has them, that a remedy is known for.

    remedies: (issue, languages, dangerous, secure). The limit is the feature: a short list for a reader.
    """
    known = found.join(remedies, "issue").groupBy("issue", "dangerous", "secure").agg(F.min("path").alias("first_path"))
    hint = F.concat(F.lit("Fix: Replace "), "dangerous", F.lit(" → "), "secure").alias("hint")
    return known.select("issue", "first_path", hint).orderBy("first_path", "issue").limit(most)


def remedied(found: DataFrame, remedies: DataFrame, kind: Column) -> DataFrame:
    """found with the remedy of its issue (null if none): one that names languages holds for these alone."""
    told = remedies.select(F.col("issue").alias("__i"), "languages", "dangerous", "secure")
    fits = (F.col("issue") == F.col("__i")) & ((F.coalesce(F.size("languages"), F.lit(0)) <= 0) | kind.isNull() | F.array_contains("languages", kind))
    return found.join(told, fits, "left").drop("__i", "languages")


# text helpers of scanners


def masked(text: Column) -> Column:
    """Source of the C family with comments blanked out: their line breaks stay, so that places don't move."""
    parts = F.regexp_extract_all(text, F.lit(r"/\*(?s:.*?)\*/|//[^\n]*"), F.lit(0))
    between = F.split(text, r"/\*(?s:.*?)\*/|//[^\n]*", -1)
    blank = F.transform(parts, lambda p: F.regexp_replace(p, r"[^\n]", " "))
    return F.concat_ws("", F.flatten(F.zip_with(between, blank, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


def arguments(call: Column) -> Column:
    """The arguments of a call's inside, split at commas outside brackets of any kind, stripped; empty for none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        ends = (c == ",") & (acc["depth"] == 0)
        depth = acc["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(
            depth.alias("depth"), F.when(ends, "").otherwise(F.concat(acc["open"], c)).alias("open"),
            F.when(ends, F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"]).alias("out"),
        )

    every = F.aggregate(F.split(call, ""), start, step, lambda acc: F.concat(acc["out"], F.array(acc["open"])))
    return F.filter(F.transform(every, stripped), lambda a: a != "")


def escaped(text: Column) -> Column:
    """For HTML: ampersands, angle brackets and both quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def constant(text: Column) -> Column:
    """The whole number that a literal tells, decimal or 0x..., with any suffix of u and l; null for anything else."""
    plain = F.lower(stripped(text))
    hexed = F.regexp_extract(plain, r"^0x([0-9a-f]{1,15})[ul]*$", 1)
    number = F.regexp_extract(plain, r"^(-?[0-9]{1,18})[ul]*$", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(number != "", number.cast("long"))


def repository(told: Column) -> dict[str, Column]:
    """owner and name of a repository by https address, ssh address or owner/name; null if it is none of these."""
    form = r"^(?:https?://[^/]+/|git@[^:]+:)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:/.*)?$"
    text = stripped(told)
    some = lambda k: F.nullif(F.regexp_extract(text, form, k), F.lit(""))
    return {"owner": some(1), "name": some(2)}
