"""Cross-file taint, import targets, functions and tainted arguments against plain loops, on random files of all languages."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import cross_file as cf
from lumenfold.operators import taint

HEADS = {
    "c": "int {f}(char *{p}, int n)\n{{", "cpp": "virtual {f}({p}) const {{", "python": "def {f}(self, {p}) -> int:", "java": "public String {f}(String {p}) throws IOException {{",
    "go": "func (r *T) {f}({p} string)", "rust": "pub fn {f}(mut {p})", "js": "const {f} = async ({p}) =>",
}
IMPORTS = {
    "c": ['#include "{m}.c"', '#include "./x/../{m}.h"', "#include <{m}.h>"], "cpp": ['#include "{m}.hpp"', '#include "../b/{m}.cpp"'],
    "python": ["import {m}", "from {m} import a, b", " import {m}", "from .{m} import x"], "java": ["import {m};", "import {m}.*;", "import java.util.List;"],
    "go": ['import "./{m}"', 'import (\n "fmt"\n "../b/{m}"\n)', 'import "fmt"'], "rust": ["use {m};", "mod {m};", "use std::{m}"],
    "js": ['import {{ a }} from "./{m}"', "const b = require('../b/{m}')", 'import x from "{m}"', 'require("./{m}.ts")'],
}


def made(seed):
    rng = random.Random(seed)
    exts = list(cf.EXTENSIONS)
    paths = sorted({f"{rng.choice(['a', 'a', 'b', '/r'])}/{rng.choice('uvw')}{rng.choice(exts)}" for _ in range(150)})
    files = {}
    for path in paths:
        lang = cf.EXTENSIONS[os.path.splitext(path)[1]]
        say = lambda w: rng.choice(["buf = {w}(q)", "{w}(val, 1)", "if = {w}", "{w}", "x: int = {w}()", "", "return {w}(buf)"]).format(w=w)  # noqa: B023, E731
        out = [rng.choice(IMPORTS[lang]).format(m=rng.choice("uvw")) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                out.append(HEADS[lang].format(f=rng.choice(["load", "save", "go"]), p=rng.choice(["buf", "val", "z"])))
            out += [say(rng.choice(cf.SOURCES[lang] + cf.SINKS[lang])) for _ in range(rng.randrange(4))]
            call = rng.choice(["load(buf, 1)", "reload(val) + save(x)", "go\n (val)", "save (buf);", "if (x) go(val, buf)", "loads(buf)"])
            out += [call, "." * rng.choice([0, 0, 0, 2100])]
        files[path] = rng.choice(["\n", "\n", "\r\n"]).join(out)
    return files | {"a/readme.md": "load(buf)", "a/none.py": None, "a/empty.c": ""}


def targets_of(path, text, lang, files):
    base, out = os.path.dirname(path), set()
    if lang in ("c", "cpp"):
        out = {os.path.normpath(os.path.join(base, n)) for n in re.findall(r'#include\s*"([^"]+)"', text)}
    elif lang == "python":
        names = [a or b for a, b in re.findall(r"(?m)^(?:from\s+([\w.]+)\s+import\s+[\w, ]+|import\s+([\w.]+))", text)]
        out = {os.path.join(base, n.replace(".", "/") + ".py") for n in names}
    elif lang == "java":
        out = {os.path.join(base, n.replace(".", "/") + ".java") for n in re.findall(r"(?m)^import\s+([\w.]+)(?:\.\*)?;", text)}
    elif lang == "go":
        names = re.findall(r'(?m)^import\s+"([^"]+)"', text) + [n for b in re.findall(r"\bimport\s*\(([^)]*)\)", text) for n in re.findall(r'"([^"]+)"', b)]
        out = {os.path.normpath(os.path.join(base, n)) for n in names if n[0] == "." or "/" in n}
    elif lang == "rust":
        out = {os.path.join(base, n.replace("::", "/") + ".rs") for n in re.findall(r"(?m)^(?:use|mod)\s+([\w:]+)", text)}
    elif lang == "js":
        for n in re.findall(r"""(?:import\s+.*?\s+from\s+|require\s*\(\s*)["']([^"']+)["']""", text):
            tried = [os.path.normpath(os.path.join(base, n + e)) for e in cf.ENDINGS]
            out |= {next((t for t in tried if t in files), n)} if n[0] == "." else set()
    return out


def functions_of(text, lang):
    found = []
    for m in re.finditer(cf.FUNCTIONS[lang].removeprefix("(?d)"), text):
        groups = [*m.groups(), None, None]
        name, params = groups[0] or groups[2], groups[1] or groups[3] or ""
        if name:
            body = text[m.end() : m.end() + 2000]
            names = [p.split()[-1].strip("*&") for p in params.split(",") if p.strip()]
            sink = any(s in body for s in cf.SINKS[lang])
            bad = [i for i, p in enumerate(names) if p and p in body and sink]
            found.append((len(found), name, text[: m.start()].count("\n") + 1, names, bad, sink, any(s in body for s in cf.SOURCES[lang]) and "return" in body))
    return found


def plain_flows(files):
    texts = {p: t.replace("\r\n", "\n").replace("\r", "\n") for p, t in files.items() if t is not None}
    langs = {p: cf.EXTENSIONS[os.path.splitext(p)[1]] for p in texts if os.path.splitext(p)[1] in cf.EXTENSIONS}
    targets = {p: targets_of(p, texts[p], g, files) for p, g in langs.items()}
    funcs = {p: functions_of(texts[p], g) for p, g in langs.items()}
    told = {}
    for path, lang in langs.items():
        rows = texts[path].split("\n")
        sources = [(i, next(s for s in cf.SOURCES[lang] if s in row), row) for i, row in enumerate(rows, 1) if any(s in row for s in cf.SOURCES[lang])]
        for other in targets[path] & langs.keys():
            for _, name, at, _, bad, sink, _ in funcs[other]:
                for m in re.finditer(rf"\b{name}\b" if lang in ("c", "cpp") else rf"\b{name}\s*\(", texts[path]):
                    line = texts[path][: m.start()].count("\n") + 1
                    args = rows[line - 1][rows[line - 1].find(name) :]
                    for i, source, row in sources:
                        put = re.search(r"^\s*(\w+)\s*(?:[:,]?\s*\w*\s*)?=", row)
                        put = put if put and put.group(1) not in cf.WORDS else re.search(r"\w+\s*\(\s*(\w+)\s*[,)]", row)
                        if put and re.search(rf"\b{put.group(1)}\b", args) and (sink or bad):
                            told.setdefault((path, i, other, name), ("cross-file-taint-flow", path, i, source, other, at, name, line, 7.5))
        for _, name, at, _, _, _, back in funcs[path]:
            for other, text in texts.items():
                near = other in langs and other != path and any(os.path.splitext(t)[0] == os.path.splitext(path)[0] for t in targets[other])
                if back and near and name in text and any(s in text for s in cf.SINKS[langs[other]]):
                    told.setdefault((path, at, other, "(caller)"), ("cross-file-taint-return", path, at, name, other, 0, "(caller)", None, 6.5))
    return targets, funcs, set(told.values())


@pytest.mark.parametrize("seed", range(3))
def test_cross_file_taint(spark, seed):
    files = made(seed)
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    targets, funcs, flows = plain_flows(files)
    assert {tuple(r) for r in cf.import_targets(rows).collect()} == {(p, t, t in files) for p, ts in targets.items() for t in ts}
    assert sorted(map(tuple, cf.functions(rows).collect())) == sorted((p, *f) for p, fs in funcs.items() for f in fs)
    told = list(map(tuple, cf.cross_file_taint(rows).collect()))
    assert len(told) == len(set(told)) and set(told) == flows
    assert {f[0] for f in flows} == {"cross-file-taint-flow", "cross-file-taint-return"}


def test_no_files(spark):
    assert cf.cross_file_taint(spark.createDataFrame([], "path string, content string")).count() == 0


def test_paths(spark):
    paths = ["a/./b//../c.x", "../../a", "/../a/..", "a/..", "", "/", "a/.hid", "x..y", "..", "a.b/c", "./m"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", cf.normalised(F.col("p")), cf.stem(F.col("p")))
    for p, norm, stem in rows.collect():
        assert (norm, stem) == (os.path.normpath(p), os.path.splitext(p)[0])


def test_first_tainted_arguments(spark):
    rng = random.Random(5)
    words = ["buf", "len", "x1", "n", "", "a.b", "$m"]
    sinks = [(rng.randrange(3), rng.choice(["overflow", "format"]), rng.randrange(4), k, rng.choice([None, "", f"{rng.choice(words)}+{rng.choice(words)}, f({rng.choice(words)})"])) for k in range(60)]
    names = [(rng.choice([None, 0, 1, 2]), rng.choice(["buf", "len", "n", "b", "m", None]), rng.randrange(5)) for _ in range(12)]
    want = {}
    for unit, issue, line, place, args in sinks:
        hits = [(place, rank, var) for u, var, rank in names if u == unit and var and re.search(rf"\b{var}\b", args or "")]
        if hits:
            want[unit, issue, line] = min(want.get((unit, issue, line), min(hits)), min(hits))
    told = taint.first_tainted_arguments(
        spark.createDataFrame(sinks, "unit int, issue string, line int, place int, args string"), spark.createDataFrame(names, "unit int, var string, rank int")
    )
    assert {tuple(r)[:3]: tuple(r)[3:] for r in told.collect()} == want and want
