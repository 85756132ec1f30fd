"""Rule scans, tool reports and import graphs on odd files."""

import re

import pytest

from lumenfold.operators import findings, flow, imports, reports, scan
from lumenfold.operators.rules import FREE, INFRASTRUCTURE, LANGUAGES, TAINT
from lumenfold.sources import text, tools

ODD = [
    ("a.c", None), ("b.c", ""), ("c.c", "\n" * 50), ("d.c", "x" * 200_000), ("e.c", "\x00 free(p);\r\nfree(p);\rfree(q); free(p);\n"),
    ("f.PY", "é = eval(x)\r\n\teval(y); eval(z)\n😀 os.system(a)"), ("g.unknown", "eval(x)"), ("h", "eval(x)"), (".c", "free(p);free(p)"),
    ("i.c", "malloc(n);\nmemcpy(a, b, n)\n" * 30), ("j.rs", "unsafe {\n" * 200), ("k.c", "for (i = 0; i <= 9;\ni <= 8; i++)"),
]


def plainly(path, content):
    """The taint rules one by one, with Python's own matching."""
    kind = LANGUAGES.get("." + path.rpartition("/")[2].rpartition(".")[2].lower()) if "." in path.rpartition("/")[2][1:] else None
    if not kind or not content:
        return
    whole = re.sub("\r\n?", "\n", content)
    lines, seen = whole.split("\n"), set()
    at = lambda m: whole[: m.start()].count("\n") + 1
    found = []
    if kind == "c":
        by = {}
        for m in re.finditer(FREE, whole):
            by.setdefault(m[1], []).append(at(m))
        found = [("C02", "double-free", n) for ns in by.values() for n in ns[1:]]
    found += [(r.id, r.issue, at(m)) for r in TAINT[kind] for m in re.finditer(r.pattern, whole)]
    for rule, issue, line in found:
        if (issue, line) not in seen:
            seen.add((issue, line))
            yield path, line, rule, issue, lines[line - 1].strip()


def test_taint_rules_on_odd_files(spark):
    told = scan.taint(spark.createDataFrame([(p, c, 1) for p, c in ODD], "path string, content string, line int")).collect()
    want = sorted(x for p, c in ODD for x in plainly(p, c))
    assert sorted((r.path, r.line, r.rule_id, r.issue, r.snippet) for r in told) == want and len(want) > 100


def test_scans_of_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    lines = spark.createDataFrame([], "path string, line int, text string")
    assert scan.taint(none).count() == scan.infrastructure(none).count() == imports.edges(none).count() == 0
    assert scan.dockerfiles(lines).count() == scan.compose_files(lines).count() == text.requirements(lines).count() == 0


def test_multi_line_rules_and_places(spark):
    made = "# x\r\ningress {\r\n  a = 1\r\n  cidr_blocks = [ \"0.0.0.0/0\" ]\r\n}\ringress {\n}\nencrypted = false encrypted=false"
    told = scan.infrastructure(spark.createDataFrame([("m/x.tf", made)], "path string, content string")).collect()
    assert sorted((r.line, r.rule_id) for r in told) == [(2, "TF003"), (8, "TF005"), (8, "TF005")]
    assert sum(map(len, INFRASTRUCTURE.values())) == 44


@pytest.mark.parametrize("read", [tools.bandit, tools.semgrep, tools.infer, tools.cppcheck, tools.clang_tidy, tools.sarif])
def test_broken_reports_hold_nothing(spark, read):
    odd = [None, "", "{", "[]", "{}", '{"results": 3}', "<results", "<results></results>", "null", '{"runs": []}', "plain text"]
    assert read(spark.createDataFrame([("p", t) for t in odd], "path string, content string")).collect() == []


def test_requirement_lines(spark):
    # lines and what they mean (fixed by the file format's rules)
    want = {"a==1": ("a", "1"), "-r x": None, "--opt a==1": None, "./p": None, " b<2 # c": ("b", "2"), "c>1.0,<2": ("c", "1.0"), "#d": None, "e;x": ("e", None), "": None}
    rows = spark.createDataFrame([(k, 1, k) for k in [*want, None]], "path string, line int, text string")
    got = {r.source_file: (r.name, r.version) for r in text.requirements(rows).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_snippets_lose_tabs_and_the_first_stage_wins(spark):
    rules = [(1, 1, "a", "x", "LOW", "", "z", ""), (2, 2, "b", "x", "HIGH", "", "z+", "z"), (3, 2, "b", "y", "HIGH", "", "q", "")]
    rows = spark.createDataFrame([("p", 1, "\t zz q \u00a0"), ("p", 2, None), ("p", 3, "")], "path string, line int, text string")
    told = findings.match_rules(rows, rules, once=["issue"]).collect()
    assert sorted((r.issue, r.stage, r.snippet) for r in told) == [("x", "a", "zz q"), ("y", "b", "zz q")]
    assert findings.match_rules(rows, rules).count() == 3


def test_dominators_of_a_large_and_a_broken_function(spark):
    chain = [(1, k, k + 1) for k in range(400)] + [(1, 0, 400), (2, 5, 6)]
    edges = spark.createDataFrame(chain, "func int, src int, dst int")
    entries = spark.createDataFrame([(1, 0), (3, 9)], "func int, node int")
    told = flow.dominators(edges, entries)
    assert {r.dom for r in told.filter("func = 1 and node = 400").collect()} == {0, 400}
    assert told.filter("func = 1 and node = 399").count() == 400
    assert told.filter("func > 1").collect() == [(3, 9, 9)]


def test_reports_of_odd_findings(spark):
    rows = spark.createDataFrame([("a", None, "x-y", None, "High", None, None), ("a", -3, "x-y", "odd", "Low", "", "s" * 500)], "path string, line int, issue string, severity string, confidence string, note string, snippet string")
    intel = spark.createDataFrame([], "issue string, cwe string, cve string, cvss double, description string, fix string")
    import json

    told = json.loads(reports.sarif_documents(rows, intel, "path").first().document)["runs"][0]
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in told["results"]] == [1, 1]
    assert {r["level"] for r in told["results"]} == {"warning"} and [r["id"] for r in told["tool"]["driver"]["rules"]] == ["x-y"]
    assert max(len(r["locations"][0]["physicalLocation"]["region"].get("snippet", {"text": ""})["text"]) for r in told["results"]) == 300


def test_names_resolve_to_the_first_file(spark):
    files = [("b/util.py", ""), ("a/util.py", ""), ("a/deep/core.py", ""), ("Z/Util.c", "#include <util.py>\n#include \"none.h\""), ("q.py", "import util\nfrom deep.core import x\nimport q"), ("n.py", None)]
    told = imports.edges(spark.createDataFrame(files, "path string, content string")).collect()
    assert sorted(map(tuple, told)) == [("Z/Util.c", "a/util.py"), ("q.py", "Z/Util.c"), ("q.py", "a/deep/core.py")]


def test_a_change_reaches_files_that_import_at_the_end_of_long_texts(spark):
    from lumenfold.operators import graphs

    far = "x = 1\n" * 20_000
    files = [("a.py", far), ("b.py", far + "import a"), ("c.js", far + "import b from './b'"), ("d.c", far + '#include "c.js"'), ("e.go", far + 'import "d"'), ("f.rs", far + "use e;"), ("g.java", far + "import f;"), ("h.py", far + "from none import a")]
    rows = spark.createDataFrame(files, "path string, content string")
    changed = spark.createDataFrame([("a.py",)], "path string")
    cone = graphs.cone(imports.reversed_edges(imports.edges(rows)), changed.withColumnRenamed("path", "node"))
    told = imports.scan_set(rows, changed, cone).collect()
    assert sorted(map(tuple, told)) == [("a.py", "changed"), *((p, "affected") for p in ("b.py", "c.js", "d.c", "e.go", "f.rs", "g.java"))]


def test_edges_of_long_lines_and_texts(spark):
    words, far = "import x, " * 100_000, "x = 1;\n" * 20_000
    files = [(f"t/{p}", "") for p in ("a.py", "b.py", "c.py", "d.py", "e.py")]
    files += [("long.js", words + "require('a')" + words + "require(\n'b')\nimport c from 'c'\n" + words + "import\nd from 'd'"), ("long.c", far + '#include "a.py"\n' + "#include <b\n" * 70_000), ("long.go", far + '"c"'), ("long.py", far + "import d\n" + far + "from e import x")]
    told = imports.edges(spark.createDataFrame(files, "path string, content string")).collect()
    want = [("long.js", c) for c in "abcd"] + [("long.c", "a"), ("long.go", "c"), ("long.py", "d"), ("long.py", "e")]
    assert sorted(map(tuple, told)) == sorted((p, f"t/{c}.py") for p, c in want)


def test_imports_of_odd_scripts_and_includes(spark):
    import random

    from pyspark.sql import functions as F

    plain = {
        ".js": r"""(?:import\s.*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))""",
        ".c": r"""#\s*include\s*[<"]([^>"]+)[>"]()""",
    }
    parts = {
        ".js": ["import", " ", "\n", "\r", "\u2028", "from", "'", '"', "require", "(", ")", "x", "from 'a'", "require('b')", "import ", "from\n\"c\"", "require(\n'd'\n)", "import\n", "from 'import r from'"],
        ".c": ["#", "include", " ", "\n", "<", ">", '"', "#include", "#include <a", '#include "b', "x"],
    }
    draw = random.Random(4)
    files = [(f"{i}{e}", "".join(draw.choice(parts[e]) + draw.choice(["", "", str(i % 9)]) for _ in range(draw.randint(2, 40)))) for i in range(4000) for e in parts]
    rows = spark.createDataFrame(files, "path string, content string")
    found = [rows.filter(F.col("path").endswith(e)).select("path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(g))).alias("name")) for e, p in plain.items() for g in (1, 2)]
    want = {tuple(r) for f in found for r in f.filter("name <> ''").collect()}
    told = [tuple(r) for r in imports.imported(rows).collect()]
    assert sorted(told) == sorted(want) and len(want) > 5000


def test_local_taint_of_odd_functions(spark):
    from lumenfold.operators import local_flow

    files = [(None, None), ("a.c", None), ("b.c", ""), ("c.c", "gets(x);\nsystem(x);"), ("d.c", "void f() {\n gets(x); system(x); system(x);\n"), ("e.c", "{ gets(x);\n}\n{\r\n y = x;\r\n gets(z); a = z; b = a;\r\n system(b)\n}")]
    told = local_flow.flows(spark.createDataFrame(files, "path string, content string")).collect()
    assert [(r.path, r.line, r.issue, r.variable, r.snippet) for r in told] == [("e.c", 6, "os-command-injection", "b", "system(b)")]


def test_text_helpers_on_odd_texts(spark):
    from lumenfold.operators import triage

    rows = spark.createDataFrame([(None,), ("",), ("/*",), ("a/**/b//",), ("((",), ("x" * 50_000,)], "t string")
    from pyspark.sql import functions as F

    told = rows.select(triage.masked(F.col("t")).alias("m"), triage.arguments(F.substring("t", 1, 100)).alias("a"), triage.constant(F.col("t")).alias("c"), triage.repository(F.col("t"))["owner"].alias("r")).collect()
    assert [r.m for r in told][:4] == [None, "", "/*", "a    b  "] or told[0].m == ""
    assert told[1].a == [] and told[4].a == ["(("] and all(r.c is None for r in told)
    assert triage.escaped(F.lit("<a b='&'>")) is not None
