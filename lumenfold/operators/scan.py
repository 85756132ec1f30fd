"""Rule tables against whole files: every match with its place, by language, without a join.

Rules are literals of the plan. A file meets only the rules of its language, each rule first asks whether it matches at
all, and only then where; hits stay in one array until they are deduplicated, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.rules import COMPOSE, CONTAINER, ENDED, FREE, INFRASTRUCTURE, LANGUAGES, OFFICIAL, TAINT, Rule


def plain(content: Column) -> Column:
    """Text with LF alone, as files are read."""
    return F.regexp_replace(content, "\r\n?", "\n")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Every match in order: array of (line, from 1, and what the group holds).

    What lies between matches comes from a split by the same pattern, so that places follow from lengths: a match's
    line is one more than the line breaks of all that stands before it.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    told = whole if group == 0 else F.regexp_extract_all(text, pattern, F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern).alias("b"), whole.alias("m"), told.alias("t"))
    none = F.array().cast("array<struct<line:int,held:string>>")
    start = F.struct(F.lit(1).alias("line"), none.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        line = acc["line"] + _breaks(s["b"])
        found = F.array(F.struct(line.cast("int").alias("line"), s["t"].alias("held")))
        after = line + F.coalesce(_breaks(s["m"]), F.lit(0))
        return F.struct(after.alias("line"), F.concat(acc["out"], F.when(s["t"].isNotNull(), found).otherwise(none)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def repeats(text: Column, pattern: str) -> Column:
    """Lines of the second and later matches that hold the same name: array of (line, held)."""
    by_name = F.array_sort(F.transform(matches(text, pattern, 1), lambda m: F.struct(m["held"].alias("held"), m["line"].alias("line"))))
    return F.filter(by_name, lambda m, i: (i > 0) & (F.get(by_name, i - 1)["held"] == m["held"]))


def language(path: Column, known: dict[str, str] = LANGUAGES) -> Column:
    """By extension, whatever its case; null if unknown."""
    ext = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^.](\.[^.]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.when(ext != "", ext))


def framework(path: Column, content: Column, charts: Column | None = None) -> Column:
    """Of an infrastructure file, by name, extension, or the first 4096 characters (2048 of JSON); null if none.

    charts: whether a Chart.yaml stands beside the folder `templates` that the file lies in.
    """
    name = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    head = F.left(content, F.lit(4096))
    has = lambda word, of=head: of.contains(word)
    yaml = (
        F.when(has("AWSTemplateFormatVersion") | has("AWS::"), "cloudformation")
        .when(has("apiVersion:") & has("kind:"), "kubernetes")
        .when(has("hosts:") & (has("tasks:") | has("roles:")), "ansible")
        .when(path.rlike("(^|/)templates/[^/]*$") & (F.lit(False) if charts is None else charts), "kubernetes")
    )
    return (
        F.when(name.isin("docker-compose.yml", "docker-compose.yaml") | name.startswith("Dockerfile"), "docker")
        .when(ext.isin(".tf", ".tfvars"), "terraform")
        .when(ext.isin(".yml", ".yaml"), yaml)
        .when((ext == ".json") & has("AWSTemplateFormatVersion", F.left(content, F.lit(2048))), "cloudformation")
    )


_HITS = "array<struct<issue:string,line:int,rule_ord:int,rule_id:string,severity:string>>"


def _rule(rule: Rule, order: int) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in ((*zip(rule._fields, rule, strict=True), ("ord", order)))))


def _hits(text: Column, kind: Column, tables: dict[str, list[Rule]]) -> Column:
    """The rules of the text's kind that match it at all, each asked once; then the places of those alone."""
    asked = F.lit(None)
    for name, rules in tables.items():
        met = [F.when(text.rlike(r.pattern), _rule(r, n)) for n, r in enumerate(rules, 1)]
        asked = F.when(kind == name, F.filter(F.array(*met), lambda r: r.isNotNull())).otherwise(asked)

    def placed(r: Column) -> Column:
        told = (r["issue"].alias("issue"), r["ord"].alias("rule_ord"), r["id"].alias("rule_id"), r["severity"].alias("severity"))
        return F.transform(matches(text, r["pattern"]), lambda m: F.struct(told[0], m["line"].alias("line"), *told[1:]))

    found = F.coalesce(F.flatten(F.transform(asked, placed)).cast(_HITS), F.array().cast(_HITS))
    if "c" not in tables:
        return found
    again = F.transform(
        repeats(text, FREE),
        lambda m: F.struct(F.lit("double-free").alias("issue"), m["line"].alias("line"), F.lit(0).alias("rule_ord"), F.lit("C02").alias("rule_id"), F.lit("HIGH").alias("severity")),
    )
    return F.when((kind == "c") & text.rlike(FREE), F.concat(again.cast(_HITS), found)).otherwise(found)


def scan(files: DataFrame, tables: dict[str, list[Rule]], kind: Column, once: bool) -> DataFrame:
    """path, kind, line, rule_id, issue, severity, snippet of each match in files (path, content).

    once: of the matches of one issue on a line the first rule's stays, as of the taint rules; else all stay. Null and
    empty contents have no match.
    """
    rows = files.select("path", plain(F.col("content")).alias("text"), kind.alias("kind"))
    names = ("line", "rule_id", "issue", "severity")

    def shown(hits: Column, lines: Column) -> Column:
        if once:
            same = lambda h, p: (p["issue"] == h["issue"]) & (p["line"] == h["line"])
            hits = F.filter(hits, lambda h, i: (i == 0) | ~same(h, F.get(hits, i - 1)))
        return F.transform(hits, lambda h: F.struct(*(h[n].alias(n) for n in names), stripped(F.get(lines, h["line"] - 1)).alias("snippet")))

    # arrays of one element bind what is used several times: hits, and the lines of files that have any
    some = F.filter(F.array(F.array_sort(_hits(F.col("text"), F.col("kind"), tables))), lambda hits: F.size(hits) > 0)
    told = F.flatten(F.transform(some, lambda hits: F.flatten(F.transform(F.array(F.split("text", "\n")), lambda lines: shown(hits, lines)))))
    # outer, so that no filter on the array's size is made of it and pushed down, which would find all hits twice
    return rows.select("path", "kind", F.explode_outer(told).alias("h")).filter("h is not null").select("path", "kind", "h.*")


def taint(files: DataFrame) -> DataFrame:
    """The taint rules of each file's language."""
    return scan(files, TAINT, language(F.col("path")), once=True)


def infrastructure(files: DataFrame) -> DataFrame:
    """The rules of each infrastructure file's framework."""
    return scan(files, INFRASTRUCTURE, framework(F.col("path"), F.col("content")), once=False)


def base_images(lines: DataFrame) -> DataFrame:
    """path, line, image, tag, digest, alias, pinned, official, ended, severity of FROM lines in (path, line, text).

    ended: the full tag or the major version is known to be past its end; the severity is that of the full tag, else
    high. A tag that is missing is latest.
    """
    told = stripped(F.col("text"))
    pattern = r"(?i)^\s*FROM\s+(?:--platform=\S+\s+)?([^\s:@]+)(?::([^\s@]+))?(?:@(sha256:\w+))?(?:\s+AS\s+(\S+))?"
    part = lambda k: F.nullif(F.regexp_extract(told, pattern, k), F.lit(""))
    rows = lines.filter(told.rlike(pattern)).select(
        "path", "line", part(1).alias("image"), F.coalesce(part(2), F.lit("latest")).alias("tag"), part(3).alias("digest"), part(4).alias("alias"), told.alias("snippet"),
        (part(2).isNull() & part(3).isNull()).alias("bare"),
    )
    base = F.substring_index("image", "/", -1)
    full = F.concat(base, F.lit(":"), F.col("tag"))
    major = F.concat(base, F.lit(":"), F.substring_index("tag", ".", 1))
    ended = F.create_map(*[F.lit(x) for kv in ENDED.items() for x in kv])
    return rows.withColumns(
        {
            "pinned": F.col("digest").isNotNull(),
            "official": base.isin(*OFFICIAL) | ~F.col("image").contains("/"),
            "ended": F.coalesce(F.element_at(ended, full), F.element_at(ended, major)).isNotNull(),
            "severity": F.coalesce(F.element_at(ended, full), F.lit("high")),
            "untagged": F.col("bare") & F.upper("snippet").startswith("FROM "),
        }
    ).drop("bare")


def _by_line(lines: DataFrame, rules: list[tuple]) -> DataFrame:
    told = stripped(F.col("text"))
    kinds = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("rule_id", "category", "severity", "cwe"), r, strict=False))) for r in rules]
    hits = [F.when(told.rlike("(?i)" + r[4]), k) for r, k in zip(rules, kinds, strict=True)]
    some = F.filter(F.array(*hits), lambda x: x.isNotNull())
    found = lines.select("path", "line", F.explode_outer(some).alias("h"), told.alias("snippet")).filter("h is not null")
    return found.select("path", "line", "h.*", "snippet")


def _mark(rule_id: str, category: str, severity: str | Column, cwe: str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), severity.alias("severity"), F.lit(cwe).alias("cwe"))


def dockerfiles(lines: DataFrame) -> DataFrame:
    """path, line, rule_id, category, severity, cwe, snippet of container build files' lines (path, line, text).

    Besides the rules by line: base images past their end or not pinned by digest or without a tag, and on line 1 that
    no line names a user other than root, or a health check. A file without lines has no finding.
    """
    images = base_images(lines)
    bare = images.filter("untagged").select("path", "line", _mark("CONT-BP-001", "base-image", "info", "CWE-1104").alias("h"), "snippet")
    old = images.filter("ended").select("path", "line", _mark("CONT-IMG-001", "base-image", F.col("severity"), "CWE-1104").alias("h"), "snippet")
    loose = images.filter("not pinned").select("path", "line", _mark("CONT-IMG-002", "base-image", "medium", "CWE-1104").alias("h"), "snippet")
    text = F.upper(stripped(F.col("text")))
    has = lines.groupBy("path").agg(
        F.coalesce(F.bool_or(text.startswith("USER ") & ~text.contains("ROOT")), F.lit(False)).alias("user"),
        F.coalesce(F.bool_or(text.startswith("HEALTHCHECK")), F.lit(False)).alias("health"),
    )
    lacks = F.array(
        F.when(~F.col("user"), F.struct(_mark("CONT-PRIV-004", "privilege", "high", "CWE-250").alias("h"), F.lit("(missing USER instruction)").alias("snippet"))),
        F.when(~F.col("health"), F.struct(_mark("CONT-BP-005", "base-image", "info", "").alias("h"), F.lit("(missing HEALTHCHECK)").alias("snippet"))),
    )
    missing = has.select("path", F.lit(1).alias("line"), F.explode(F.filter(lacks, lambda x: x.isNotNull())).alias("m")).select("path", "line", "m.h", "m.snippet")
    told = old.unionByName(loose).unionByName(bare).unionByName(missing).select("path", "line", "h.*", "snippet")
    return _by_line(lines, CONTAINER).unionByName(told)


def compose_files(lines: DataFrame) -> DataFrame:
    """path, line, rule_id, category, severity, cwe, snippet of compose files' lines (path, line, text)."""
    return _by_line(lines, COMPOSE)
