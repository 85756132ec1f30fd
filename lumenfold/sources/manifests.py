"""Dependencies out of package manifests: name, version (null if none), source_file.

Each reader takes (path, content) and follows the rules of its format. A file is read as one value, in arrays, so that a
section that stays open over lines needs no sort and no shuffle. A null or broken file holds no dependency.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.scan import plain, stripped

# Names of the sections and blocks that hold dependencies (fixed by the formats).
PACKAGE_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
CARGO_SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]
GRADLE_CALLS = [
    "implementation", "api", "compileOnly", "runtimeOnly", "compile", "testImplementation", "testCompileOnly",
    "testRuntimeOnly", "testCompile", "annotationProcessor", "kapt", "classpath",
]

_ENTRIES = "array<struct<section:string,key:string,value:string>>"


def _rows(files: DataFrame, found: Column) -> DataFrame:
    """found: array of structs (name, version)."""
    out = files.select(F.col("path").alias("source_file"), F.explode_outer(found).alias("d")).filter("d.name <> ''")
    return out.select("source_file", "d.name", F.nullif("d.version", F.lit("")).alias("version"))


def _dependency(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), F.nullif(version, F.lit("")).alias("version"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """The array that then makes of a value that it uses several times: an array of one holds it, so it is made once."""
    return F.flatten(F.transform(F.array(value), then))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']|[\"']$", "")


def _bare(version: Column) -> Column:
    """A version without the comparison before it; of several conditions the first."""
    return F.regexp_extract(version, r"^[\s\^~>=<!]*([^\s,;|]*)", 1)


def toml(content: Column) -> Column:
    """Every assignment of a TOML file, in order: (section, key, value as written).

    Comments go, tables in brackets open a section (its name without quotes and blanks), quoted keys lose their quotes,
    and a list that stays open goes on over the following lines. Lines that are none of these are passed over. Repeats
    are possessive, as others would need a stack as deep as a line is long.
    """
    lines = F.split(plain(content), "\n")
    start = F.struct(F.lit("").alias("section"), F.lit("").alias("open"), F.array().cast(_ENTRIES).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        told = stripped(F.regexp_replace(line, r"""^((?:[^"'#]++|"[^"]*+"|'[^']*+')*+)#.*$""", "$1"))
        told = F.when(acc["open"] != "", F.concat(acc["open"], F.lit(" "), told)).otherwise(told)
        header = told.rlike(r"^\[[^=]*\]$")
        opens = ~header & told.rlike(r"^[^=]+=\s*\[") & ~told.rlike(r"\]$")
        key, value = (stripped(F.regexp_extract(told, r"""^("[^"]*"|'[^']*'|[^=\[]+?)\s*=\s*(.*)$""", k)) for k in (1, 2))
        name = F.regexp_replace(F.regexp_extract(told, r"^\[+(.*?)\]+$", 1), "[\"'\\s]", "")
        entry = F.array(F.struct(acc["section"].alias("section"), _unquoted(key).alias("key"), value.alias("value")))
        ends = ~header & ~opens & (key != "")
        return F.struct(
            F.when(header, name).otherwise(acc["section"]).alias("section"),
            F.when(opens, told).otherwise("").alias("open"),
            F.when(ends, F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def _version_of(value: Column) -> Column:
    """The version that a TOML value tells: a string, or the `version` of an inline table."""
    inside = F.regexp_extract(value, r"""[{,]\s*version\s*=\s*["']([^"']*)""", 1)
    return F.when(value.startswith("{"), _bare(inside)).when(value.rlike("^[\"']"), _bare(_unquoted(value))).otherwise("")


def _requirement(text: Column) -> Column:
    name = F.regexp_extract(text, r"^\s*([A-Za-z0-9._-]+)", 1)
    return _dependency(name, _bare(F.regexp_extract(text, r"^\s*[A-Za-z0-9._-]+\s*(?:\[[^\]]*\])?\s*\(?\s*([=~!<>].*)$", 1)))


def pyproject(files: DataFrame) -> DataFrame:
    """A project's lists of requirements (its own, optional ones, and those of its build), and the dependency tables of
    poetry, but for the language itself."""

    def found(every: Column) -> Column:
        lists = F.filter(
            every,
            lambda e: ((e["section"] == "project") & (e["key"] == "dependencies")) | (e["section"] == "project.optional-dependencies") | ((e["section"] == "build-system") & (e["key"] == "requires")),
        )
        strings = F.flatten(F.transform(lists, lambda e: F.regexp_extract_all(e["value"], F.lit(r"""(["'])(.*?)\1"""), F.lit(2))))
        tables = F.filter(every, lambda e: e["section"].rlike(r"^tool\.poetry\.(?:group\.[^.]+\.)?(?:dev-)?dependencies$") & (F.lower(e["key"]) != "python"))
        return F.concat(F.transform(strings, _requirement), F.transform(tables, lambda e: _dependency(e["key"], _version_of(e["value"]))))

    return _rows(files, _bound(toml(F.col("content")), found))


def cargo(files: DataFrame) -> DataFrame:
    """Crates of the dependency tables, also of a target's, and of tables of their own (`[dependencies.name]`)."""
    kinds = "|".join(CARGO_SECTIONS)

    def plainly(every: Column) -> Column:
        tables = F.filter(every, lambda e: e["section"].rlike(rf"(^|\.)(?:{kinds})$"))
        other = lambda e: e["key"].rlike(r"\.") & ~e["key"].endswith(".version")
        return F.transform(tables, lambda e: _dependency(F.substring_index(e["key"], ".", 1), F.when(other(e), "").otherwise(_version_of(e["value"]))))

    def apart(tables: Column) -> Column:
        names = F.array_distinct(F.transform(tables, lambda e: F.substring_index(e["section"], ".", -1)))
        version = lambda n: F.get(F.filter(tables, lambda e: e["section"].endswith(F.concat(F.lit("."), n)) & (e["key"] == "version")), F.lit(0))["value"]
        return F.transform(names, lambda n: _dependency(n, F.coalesce(_version_of(version(n)), F.lit(""))))

    def found(every: Column) -> Column:
        own = F.filter(every, lambda e: e["section"].rlike(rf"(^|\.)(?:{kinds})\.[^.]+$"))
        return F.concat(plainly(every), _bound(own, apart))

    return _rows(files, _bound(toml(F.col("content")), found))


def go_mod(files: DataFrame) -> DataFrame:
    """Modules that a file requires, in blocks or alone, without comments; what replaces or excludes them is no dependency."""
    text = F.regexp_replace(plain(F.col("content")), r"//[^\n]*", "")
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*require[ \t]*\(([^)]*)\)"), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*require[ \t]+([^\s(]+[ \t]+\S+)"), F.lit(1))
    lines = F.concat(alone, F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))))
    words = F.filter(F.transform(lines, lambda x: F.split(stripped(x), r"\s+")), lambda w: F.size(w) >= 2)
    return _rows(files, F.transform(words, lambda w: _dependency(_unquoted(F.get(w, F.lit(0))), F.get(w, F.lit(1)))))


def gradle(files: DataFrame) -> DataFrame:
    """group:artifact and version of what follows a dependency call, in either quotes, with or without parentheses, also
    on the next line; as one text or by the names group, name and version. A version that is a variable counts as none."""
    text = F.regexp_replace(plain(F.col("content")), r"(?m)^\s*//.*$", "")
    call = rf"\b(?:{'|'.join(GRADLE_CALLS)})\b\s*\(?\s*"
    one = F.regexp_extract_all(text, F.lit(call + r"""(?:platform\s*\(\s*)?["']([^"':\s]+:[^"':\s]+(?::[^"'\s]+)?)["']"""), F.lit(1))
    told = F.transform(one, lambda c: F.split(c, ":"))
    first = F.transform(told, lambda p: _dependency(F.concat_ws(":", F.get(p, F.lit(0)), F.get(p, F.lit(1))), F.regexp_extract(F.coalesce(F.get(p, F.lit(2)), F.lit("")), r"^([^$@]*)", 1)))
    named = F.regexp_extract_all(text, F.lit(call + r"""((?:(?:group|name|version)\s*[:=]\s*["'][^"']*["']\s*,?\s*){2,3})"""), F.lit(1))
    part = lambda t, n: F.regexp_extract(t, rf"""\b{n}\s*[:=]\s*["']([^"']*)""", 1)
    second = F.transform(named, lambda t: _dependency(F.concat_ws(":", part(t, "group"), part(t, "name")), F.regexp_extract(part(t, "version"), r"^([^$]*)", 1)))
    return _rows(files, F.concat(first, second))


def package_json(files: DataFrame) -> DataFrame:
    """Entries of the dependency sections; a version that is an object or a list counts as none, broken JSON has no entry."""
    kind = ", ".join(f"{s} map<string, string>" for s in PACKAGE_SECTIONS)
    told = F.from_json("content", kind)
    none = F.array().cast("array<struct<key:string,value:string>>")
    every = F.concat(*[F.coalesce(F.map_entries(told[s]), none) for s in PACKAGE_SECTIONS])
    plainly = lambda v: F.when(~v.rlike(r"^[\[{]"), F.regexp_replace(v, r"^[\^~>=<! ]+", ""))
    return _rows(files, F.transform(every, lambda e: _dependency(e["key"], plainly(e["value"]))))


def pom(files: DataFrame) -> DataFrame:
    """group:artifact of every dependency that names both, also of those that are managed or belong to a profile; read as
    XML, so comments and other elements between do no harm."""
    one = "dependency:array<struct<groupId:string,artifactId:string,version:string>>"
    kind = f"dependencies struct<{one}>, dependencyManagement struct<dependencies:struct<{one}>>, profiles struct<profile:array<struct<dependencies:struct<{one}>>>>"
    x = F.from_xml("content", kind, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<struct<groupId:string,artifactId:string,version:string>>")
    some = lambda c: F.coalesce(c, none)
    profiles = F.flatten(F.transform(x["profiles"]["profile"], lambda p: some(p["dependencies"]["dependency"])))
    every = F.concat(some(x["dependencies"]["dependency"]), some(x["dependencyManagement"]["dependencies"]["dependency"]), some(profiles))
    whole = F.filter(every, lambda d: d["groupId"].isNotNull() & d["artifactId"].isNotNull())
    return _rows(files, F.transform(whole, lambda d: _dependency(F.concat_ws(":", stripped(d["groupId"]), stripped(d["artifactId"])), F.coalesce(stripped(d["version"]), F.lit("")))))
