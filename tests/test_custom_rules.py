"""Users' rules against plain loops, on random files and patterns with and without required literals."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import custom_rules as cr

RULE = "id string, pattern string, message string, severity string, languages array<string>, cwe string, fix string"
PATTERNS = [
    r"memcpy\s*\(", r"strn?cpy\(", r"eval|exec", r"(?i)PASSWORD", r"password\s*=\s*\w+", r"(foo)?bar", r"(foo)+bar", r"a{2,3}bcd*", r"[abc]def", r"\bexec\b", r"^import (\w+)$", r"x\d+_y",
    r"tok\.en", r"end$", r".", r"lock\(\s*\n\s*mu", "passwords?", "passwords*_x", "(?:ab)?cde", r"\x61\x61bcd", r"(o)\1bar",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_custom_scan(spark, seed):
    rng = random.Random(seed)
    words = ["memcpy (a)", "my_memcpy(b)", "strcpy(", "strncpy(", "exec", "password = x1", "passwords", "password_x", "foobar", "foofoobar", "bar", "aabc", "aaabcddd", "cdef", "import os", "x12_y", "token", "tok.en", "lock( \n mu", "the end", "abcde", "", "é"]
    texts = {f"d/f{k}{rng.choice([*cr.EXTENSIONS, '.txt', ''])}": rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(words) for _ in range(rng.randrange(12))) for k in range(60)}
    langs = [None, [], ["c"], ["python", "java"], ["c", "cpp", "go", "rust"], ["nosuch"]]
    rules = [(f"r{k % 25}", rng.choice(PATTERNS), f"m{k}", "LOW", rng.choice(langs), "", "") for k in range(40)]
    rules.append(rules[0])
    want = []
    for path, text in texts.items():
        text, lang = re.sub("\r\n?", "\n", text), cr.EXTENSIONS.get(os.path.splitext(path)[1])
        for rule, pattern, message, _, admitted, *_ in rules:
            if not (admitted and lang and lang not in admitted):
                for m in re.finditer(pattern, text, re.MULTILINE):
                    line = text[: m.start()].count("\n")
                    want.append((path, line + 1, rule, message, text.split("\n")[line].strip()))
    files = spark.createDataFrame([*texts.items(), ("null.c", None)], "path string, content string")
    told = cr.custom_scan(files, spark.createDataFrame(rules, RULE)).select("path", "line", "id", "message", "snippet").collect()
    assert sorted(map(tuple, told)) == sorted(want) and want
    empty = spark.createDataFrame([], RULE)
    assert cr.custom_scan(files, empty).count() == 0 == cr.custom_scan(files.limit(0), spark.createDataFrame(rules, RULE)).count()


def test_literals_are_in_every_match(spark):
    told = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", cr.required_literal(F.col("p")).alias("need")).collect()
    have = {r.p: r.need for r in told}
    assert have[r"memcpy\s*\("] == "memcpy" and have[r"strn?cpy\("] is not None and have[r"eval|exec"] is None and have["passwords*_x"] == "password"
    assert have["(foo)?bar"] is None and have["(foo)+bar"] in ("foo", "bar") and have["(?i)PASSWORD"] is None and have["a{2,3}bcd*"] is None


def test_read_rules(spark):
    text = """# ours
rules:
  - id: 'one'
    pattern: "a: b\\s+c"
    severity: critical
    languages: [c, "cpp", ]
    cwe: CWE-1

  - id: two
    pattern: x
    languages:
      - go
      # not this
      - 'rust'
    fix: use y
  - id: three
    message: no pattern
  - id: four
    pattern: "("
"""
    files = spark.createDataFrame([("a.yml", text), ("b.yml", "rules: []"), ("c.yml", None), ("d.yml", "")], "path string, content string")
    assert sorted(map(tuple, cr.read_rules(files).collect())) == [
        ("one", "a: b\\s+c", "Custom rule violation", "CRITICAL", ["c", "cpp"], "CWE-1", ""),
        ("two", "x", "Custom rule violation", "MEDIUM", ["go", "rust"], "", "use y"),
    ]
