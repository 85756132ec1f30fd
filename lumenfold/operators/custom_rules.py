"""Rules that users bring, as a table: read from rule files, and matched by an index of the literals that their patterns require."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lumenfold.operators.scan import language, matches, plain, stripped
from lumenfold.sources.text import lines

# Languages by extension (fixed values).
EXTENSIONS = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".php": "php", ".rb": "ruby", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".scala": "scala", ".sc": "scala",
}
_RULE = ["id", "pattern", "message", "severity", "languages", "cwe", "fix"]
# So many letters of a literal are the key that words meet it by.
_KEY = 3


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stripped(text), r'^"+|"+$', ""), r"^'+|'+$", "")


@F.udf(BooleanType())
def _compiles(pattern: str | None) -> bool:
    """A row of the rule table at a time; that table is a configuration, not data."""
    try:
        return bool(pattern) and re.compile(pattern) is not None
    except re.error:
        return False


def read_rules(files: DataFrame) -> DataFrame:
    """id, pattern, message, severity, languages, cwe, fix of the rules in rule files (path, content).

    A rule begins at `- id:`; its fields are `key: value`, lists in brackets or as items below a key without a value.
    Values lose their quotes; comments and blank lines count as nothing. A rule without a pattern, or with one that is
    no regular expression, is left out; a missing message, severity or list gets its default.
    """
    text = F.col("text")
    told = lines(files).select("path", "line", stripped(F.col("text")).alias("text")).filter((text != "") & ~text.startswith("#"))
    start, item = text.startswith("- id:"), text.startswith("- ") & ~text.startswith("- id:")
    order = Window.partitionBy("path").orderBy("line")  # a rule file is one document
    told = told.withColumn("n", F.sum(start.cast("int")).over(order)).filter("n > 0")
    field = F.when(~item & text.contains(":"), F.struct(stripped(F.regexp_replace(F.substring_index("text", ":", 1), r"^-\s*", "")).alias("key"), _bare(F.regexp_extract("text", r"(?s)^[^:]*:(.*)$", 1)).alias("value")))
    told = told.withColumn("field", F.last(field, ignorenulls=True).over(Window.partitionBy("path", "n").orderBy("line")))
    one = F.when(item, F.when(F.col("field.value").isin("", "[]"), F.array(_bare(F.substring(text, 3, F.lit(1 << 30))))))
    listed = F.filter(F.transform(F.split(F.regexp_extract("field.value", r"^\[(.*)\]$", 1), ","), _bare), lambda x: x != "")
    several = F.when(F.col("field.value").rlike(r"^\[.*\]$"), listed)
    value = F.when(~item & ~F.coalesce(F.col("field.value").isin("", "[]"), F.lit(True)), F.col("field.value"))
    cells = told.select("path", "n", "line", F.col("field.key").alias("key"), value.alias("value"), F.coalesce(one, several).alias("items"))
    rows = cells.groupBy("path", "n").agg(
        *(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when((F.col("key") == k) & F.col("value").isNotNull(), F.col("line"))).alias(k) for k in _RULE if k != "languages"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("key") == "languages") & F.col("items").isNotNull(), F.struct("line", "items")))), lambda s: s["items"])).alias("languages"),
    )
    rows = rows.filter(_compiles("pattern"))
    given = {"message": F.coalesce("message", F.lit("Custom rule violation")), "severity": F.upper(F.coalesce("severity", F.lit("MEDIUM")))}
    return rows.select(*(given.get(k, F.col(k) if k in ("id", "pattern", "languages") else F.coalesce(k, F.lit(""))).alias(k) for k in _RULE))


def required_literal(pattern: Column) -> Column:
    """The longest run of three or more word characters that each match of the pattern holds, or null where none is sure.

    Patterns with alternatives, flags, look-around, escapes by number or groups that may be left out give none. Other escapes, classes, and
    characters that may be left out end a run.
    """
    simple = F.regexp_replace(F.regexp_replace(pattern, r"\\.", "\u0001"), r"\[\^?\]?[^\]]*\]", "\u0001")
    unsure = pattern.rlike(r"\\[xuUcQkN0-9]") | simple.contains("|") | simple.contains("(?") | simple.rlike(r"\)[?*{]")
    runs = F.regexp_extract_all(F.regexp_replace(simple, r".(?:[?*]|\{[^}]*\})", "\u0001"), F.lit(r"([A-Za-z0-9_]{3,})"), F.lit(1))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r), r.alias("run"))))["run"]
    return F.when(~unsure, longest)


def custom_scan(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path, line, id, severity, message, snippet, cwe, fix: every match of users' rules in files (path, content), one row a path.

    A rule with languages is asked of files of these and of files whose language is unknown. A rule with a required
    literal is asked only of files with a word that holds it: words and literals meet by equal beginnings at each place
    of the distinct words, so that a rule more does not mean a pass over all texts more. Rules without one are asked of
    all files that their languages admit. Null contents match nothing; repeated rules find repeatedly.
    """
    rows = files.select("path", plain(F.col("content")).alias("text"), F.coalesce(language(F.col("path"), EXTENSIONS), F.lit("")).alias("lang")).filter("text is not null")
    table = rules.withColumn("rule", F.struct(*_RULE)).select("rule", required_literal(F.col("pattern")).alias("literal"))
    # what a rule may be asked of: each language, and files of none
    every = sorted({*EXTENSIONS.values(), ""})
    admitted = F.when(F.size(F.coalesce("rule.languages", F.array().cast("array<string>"))) == 0, F.array(*map(F.lit, every))).otherwise(F.array_distinct(F.concat("rule.languages", F.array(F.lit("")))))
    always = table.filter("literal is null").select("rule", F.explode(admitted).alias("lang")).groupBy("lang").agg(F.collect_list("rule").alias("always"))

    words = rows.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w{3,})"), F.lit(1)))).alias("word"))
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - (_KEY - 1)), lambda i: F.substring(F.col("word"), i, F.lit(_KEY))))
    literals = table.filter("literal is not null").select("literal").distinct().withColumn("key", F.left("literal", F.lit(_KEY)))
    holding = words.select("word").distinct().select("word", F.explode(keys).alias("key")).join(literals, "key").filter(F.col("word").contains(F.col("literal"))).select("word", "literal")
    indexed = table.filter("literal is not null").groupBy("literal").agg(F.collect_list("rule").alias("some"))
    met = words.join(holding, "word").select("path", "literal").distinct().join(indexed, "literal").groupBy("path").agg(F.flatten(F.collect_list("some")).alias("some"))

    none = F.array().cast(table.select(F.array("rule")).schema[0].dataType)
    asked = F.filter(F.coalesce("some", none), lambda r: (F.col("lang") == "") | (F.coalesce(F.size(r["languages"]), F.lit(0)) <= 0) | F.array_contains(r["languages"], F.col("lang")))
    found = lambda r: F.transform(matches(F.col("text"), F.concat(F.lit("(?md)"), r["pattern"])), lambda m: F.struct(m["line"].alias("line"), r.alias("r")))
    hits = F.flatten(F.transform(F.concat(asked, F.coalesce("always", none)), found))
    told = rows.join(met, "path", "left").join(always, "lang", "left").filter("some is not null or always is not null")
    shown = F.transform(hits, lambda h: F.struct(h["line"].alias("line"), *(h["r"][k].alias(k) for k in ("id", "severity", "message", "cwe", "fix")), stripped(F.get(F.split("text", "\n"), h["line"] - 1)).alias("snippet")))
    return told.select("path", F.explode(shown).alias("h")).select("path", "h.*")
