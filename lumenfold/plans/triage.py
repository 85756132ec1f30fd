"""Queries of suppression, scores, fixes, local taint, licences, advisories and text helpers, with SQL.

As the tables hold no code, cases are made from rows by their numbers; the SQL says what each case must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import intervals
from lumenfold.operators import local_flow, supply, triage
from lumenfold.plans.registry import query, read, spread, values

#: Paths and functions, and whether they are tests or generated.
_PATHS = [
    ("src/tests/a.c", True, False), ("src/test_x.py", True, False), ("a/conftest.py", True, False), ("FooTest.java", True, False), ("src/contents.c", False, False),
    ("src/latest.c", True, False), ("gen/auto_generated.c", False, True), ("x/codegen.py", False, True), ("x/plain.py", False, False), ("thrift/a.py", False, False),
]


@query(f"WITH p(n, path, test, generated) AS (VALUES {values([(n, *p) for n, p in enumerate(_PATHS)])}) SELECT event_id, test, generated OR event_id % 3 = 0 AS generated FROM events JOIN p ON n = event_id % {len(_PATHS)}")
def p9_tests_and_generated(spark, d):
    path = F.get(F.array(*[F.lit(p) for p, _, _ in _PATHS]), (F.col("event_id") % len(_PATHS)).cast("int"))
    head = F.expr("if(event_id % 3 = 0, '/* Generated BY x */', 'int x;')")
    return read(spark, d, "events").select("event_id", triage.test_file(path).alias("test"), triage.generated_file(path, head).alias("generated"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Findings from events: the marks and words of each follow from its number."""
    return read(spark, d, "events").select(
        "event_id", F.expr("if(event_id % 7 = 0, 'src/tests/f.c', 'src/f' || user_id || '.c')").alias("path"), F.col("event_type").alias("issue"), F.expr("cast(event_id % 20 as int)").alias("line"),
        F.expr("if(event_id % 4 = 0, 'ab', 'strcpy(a, b)')").alias("snippet"), F.expr("element_at(array('High', 'Medium', 'Low', 'odd'), cast(event_id % 4 + 1 as int))").alias("confidence"),
        F.expr("if(event_id % 2 = 0, 5, null)").alias("source_line"), F.expr("if(event_id % 6 = 0, 5, 9)").alias("sink_line"), F.expr("if(event_id % 11 = 0, '// do not edit', '')").alias("head"),
        F.expr("event_id % 13 = 0").alias("dead"), F.expr("if(event_id % 17 = 0, true, null)").alias("guarded"), F.expr("if(event_id % 5 = 0, 'testThing', 'run')").alias("function"),
    )


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'src/tests/f.c' ELSE 'src/f' || user_id || '.c' END AS path, event_type AS issue, (event_id % 20)::INT AS line FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY path, issue, line ORDER BY event_id) AS nth,
      CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 1 ELSE [3, 2, 1, 2][event_id % 4 + 1] END AS base FROM t),
    s AS (SELECT *, greatest(least(base + CASE WHEN event_id % 2 = 0 AND event_id % 6 <> 0 THEN 1 ELSE 0 END, 3) - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END, 1) AS level FROM n)
    SELECT event_id, ['Low', 'Medium', 'High'][level] AS confidence, CASE WHEN nth > 1 THEN 'duplicate' WHEN event_id % 11 = 0 THEN 'generated_code' WHEN event_id % 13 = 0 THEN 'dead_code'
      WHEN event_id % 17 = 0 THEN 'sanitizer_dominates' END AS reason FROM s""")
def p12_suppression(spark, d):
    return triage.triaged(_told(spark, d), ["event_id"]).select("event_id", "confidence", "reason")


_STAGE_OF = [("Taint", 0.7), ("LLVM", 0.9), ("Interprocedural", 0.85), ("none", 0.5)]
_ISSUE_OF = [("format-string", 0.9), ("data-race", 0.8), ("odd", 0.4)]


@query(f"""WITH i(n, issue, i) AS (VALUES {values([(n, *v) for n, v in enumerate(_ISSUE_OF)])}), g(n, stage, g) AS (VALUES {values([(n, *v) for n, v in enumerate(_STAGE_OF)])}),
    t AS (SELECT event_id, 0.3 * i + 0.2 * [1.0, 0.6, 0.3][event_id % 3 + 1] + 0.15 * g + 0.02 * least(1.0, event_id / 5000.0) + 0.03 * least(1.0, length(event_type) * 30 / 200.0)
      + 0.05 * least(1.0, (4 + length(event_id::VARCHAR)) / 500.0) + 0.08 * (event_id % 2) + 0.07 * (event_id % 4 = 2)::INT + 0.07 * (event_type = 'error')::INT AS score, event_id % 3 = 0 AS high
      FROM events JOIN i ON i.n = event_id % 3 JOIN g ON g.n = event_id % 4)
    SELECT event_id, round(score, 6)::DOUBLE AS score FROM t WHERE high OR score >= 0.35""")
def p13_p14_score(spark, d):
    pick = lambda rows: "element_at(array(" + ", ".join(f"'{v}'" for v, _ in rows) + f"), cast(event_id % {len(rows)} + 1 as int))"
    rows = read(spark, d, "events").select(
        "event_id", F.expr(pick(_ISSUE_OF)).alias("issue"), F.expr("element_at(array('high', 'Medium', 'LOW'), cast(event_id % 3 + 1 as int))").alias("confidence"), F.expr(pick(_STAGE_OF)).alias("stage"),
        F.col("event_id").alias("line"), F.expr("if(event_type = 'error', 'gets(' || repeat('x', 145), repeat('x', length(event_type) * 30))").alias("snippet"),
        F.expr("if(event_id % 2 = 1, 'CVE-', 'none') || event_id").alias("note"),
    )
    return triage.likely(rows).select("event_id", F.round("score", 6).alias("score"))


#: Lines of files, the issue found on them, and what a fix makes of them (null: none).
_FIXABLE = [
    ("c", "  gets( buf{k} ) ; // x", "stack-buffer-overflow", "  fgets(buf{k}, sizeof(buf{k}), stdin); // x", "High"),
    ("c", "strcpy(a{k}, b);", "buffer-overflow", "strncpy(a{k}, b, sizeof(a{k}) - 1);\na{k}[sizeof(a{k}) - 1] = '\\0';", "High"),
    ("c", "strcpy(a{k}, b);", "stack-buffer-overflow", None, None),
    ("c", "printf(x{k}); printf(y);", "format-string", 'printf("%s", x{k}); printf("%s", y);', "High"),
    ("c", "eval(x{k})", "insecure-eval", None, None),
    ("py", "os.system( cmd{k} )", "os-command-injection", "subprocess.run(cmd{k}, shell=False, check=True)", "High"),
    ("py", "subprocess.call(c{k}, shell = True)", "os-command-injection", "subprocess.run(c{k}, shell=False)", "High"),
    ("py", "h = hashlib.sha1(x{k})", "weak-crypto", "h = hashlib.sha256(x{k})", "High"),
    ("py", "token = 'abcd{k}'  ", "hardcoded-password", 'token = os.environ.get("token", "")', "Medium"),
    ("go", "InsecureSkipVerify:true, // {k}", "insecure-tls", "InsecureSkipVerify: false, // {k}", "High"),
    ("rs", "gets(buf{k});", "stack-buffer-overflow", None, None),
]


def _fixable(spark: SparkSession, d: str) -> DataFrame:
    """path, line, text, issue: a file for each part and ending."""
    cases = [F.struct(F.lit(e).alias("e"), F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("text"), F.lit(i).alias("issue")) for e, t, i, _, _ in _FIXABLE]
    rows = spread(spark, d, "part", "p_partkey").select("p_partkey", F.posexplode(F.array(*cases)).alias("line", "c"))
    return rows.select(F.concat(F.lit("p"), "p_partkey", F.lit("."), "c.e").alias("path"), "line", "c.text", "c.issue")


def _kind():
    end = F.substring_index("path", ".", -1)
    return F.when(end == "py", "python").otherwise(end)


_SQL_FIXED = f"""f(line, e, text, issue, fixed, confidence) AS (VALUES {values([(n, *c) for n, c in enumerate(_FIXABLE)])}),
    m AS (SELECT 'p' || p_partkey || '.' || e AS path, line, issue, rtrim(replace(text, '{{k}}', p_partkey::VARCHAR)) AS original, replace(fixed, '{{k}}', p_partkey::VARCHAR) AS fixed, confidence FROM part, f)"""


@query(f"WITH {_SQL_FIXED} SELECT * FROM m WHERE fixed IS NOT NULL")
def d24_j29_fixes(spark, d):
    rows = _fixable(spark, d)
    return triage.fixes(rows.select("path", "line", "issue"), rows.select("path", "line", "text"), _kind())


@query(f"""WITH {_SQL_FIXED} SELECT path, line, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || line || ' +' || line || CASE WHEN contains(fixed, chr(10)) THEN ',2' ELSE '' END || ' @@' || chr(10)
    || '-' || original || chr(10) || '+' || replace(fixed, chr(10), chr(10) || '+') || chr(10) AS patch FROM m WHERE fixed IS NOT NULL""")
def k8_patches(spark, d):
    rows = _fixable(spark, d)
    return triage.patches(triage.fixes(rows.select("path", "line", "issue"), rows.select("path", "line", "text"), _kind()))


@query(f"WITH {_SQL_FIXED} SELECT path, line, coalesce(m.fixed, replace(f.text, '{{k}}', regexp_extract(path, '[0-9]+'))) AS text FROM m JOIN f USING (line)")
def k8_applied(spark, d):
    rows = _fixable(spark, d)
    lines = rows.select("path", "line", "text")
    return triage.applied(lines, triage.fixes(rows.select("path", "line", "issue"), lines, _kind()))


_REMEDIES = [("click", ["c", "cpp"], "gets", "fgets"), ("error", [], "eval", "parse"), ("view", None, "md5", "sha256")]


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'gets' WHEN event_type = 'click' AND event_id % 3 = 2 THEN 'gets' WHEN event_type = 'error' THEN 'eval' WHEN event_type = 'view' THEN 'md5' END AS dangerous FROM events""")
def j4_remedies(spark, d):
    """Remedies that name languages hold for these and where the language is unknown."""
    remedies = spark.createDataFrame(_REMEDIES, "issue string, languages array<string>, dangerous string, secure string")
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("issue"), F.expr("element_at(array('c', 'go', null), cast(event_id % 3 + 1 as int))").alias("kind"))
    return triage.remedied(rows, F.broadcast(remedies), F.col("kind")).select("event_id", "dangerous")


@query("""WITH r(issue, hint) AS (VALUES ('click', 'Fix: Replace gets → fgets'), ('error', 'Fix: Replace eval → parse'), ('view', 'Fix: Replace md5 → sha256'))
    SELECT event_type AS issue, min(user_id) AS first_path, hint FROM events JOIN r ON issue = event_type GROUP BY 1, 3 ORDER BY first_path, issue LIMIT 8""")
def w6_hints(spark, d):
    remedies = spark.createDataFrame(_REMEDIES, "issue string, languages array<string>, dangerous string, secure string")
    return triage.hinted(read(spark, d, "events").select(F.col("event_type").alias("issue"), F.col("user_id").alias("path")), F.broadcast(remedies), 8)


#: Functions, and what reaches a sink in them: line within the function, issue, confidence, variable.
_FUNCTIONS = [
    ('void f{k}(int s) {\n  char *p = getenv("X");\n  char *q = p;\n  strcpy(buf, q);\n}', [(4, "stack-buffer-overflow", "HIGH", "q", "strcpy(buf, q);")]),
    ("int g{k}(void) {\n  gets(buf);\n  if (strlen(buf) < 9)\n    printf(buf);\n}", []),
    ("void h{k}()\n{\n  int n = atoi(a);\n  x[n] = malloc(n);\n  system(z);\n}", [(4, "negative-index", "MEDIUM", "n", "x[n] = malloc(n);"), (4, "integer-overflow", "MEDIUM", "n", "x[n] = malloc(n);")]),
    ("void i{k}() {\n  strcpy(a, b);\n}", []),
    ("void j{k}() {\n  while (1) {\n    read(fd, r, 9);\n  }\n  a = r;\n  b = a;\n\tmemcpy(d, s, b); printf(b); printf(a);\n}", [(7, "heap-buffer-overflow", "HIGH", "b", "memcpy(d, s, b); printf(b); printf(a);"), (7, "format-string", "HIGH", "b", "memcpy(d, s, b); printf(b); printf(a);")]),
]


@query(f"""WITH n(i, lines, head) AS (VALUES {values([(i, b.count(chr(10)) + 1, 1 if b.split(chr(10))[1] == '{' else 0) for i, (b, _) in enumerate(_FUNCTIONS)])}),
    w(i, off, issue, confidence, variable, snippet) AS (VALUES {values([(i, *x) for i, (_, xs) in enumerate(_FUNCTIONS) for x in xs])}),
    f AS (SELECT p_partkey AS k, p_partkey % 5 AS a, (p_partkey * 2 + 1) % 5 AS b FROM part)
    SELECT 'p' || k || '.c' AS path, off AS line, issue, confidence, variable, snippet FROM f JOIN w ON w.i = a
    UNION ALL SELECT 'p' || k || '.c', lines + 1 + off, issue, confidence, variable, snippet FROM f JOIN n ON n.i = a JOIN w ON w.i = b""")
def d10_local_taint(spark, d):
    bodies = F.array(*[F.lit(b) for b, _ in _FUNCTIONS])
    part = lambda e: F.get(bodies, F.expr(f"cast(({e}) % 5 as int)"))
    text = F.replace(F.concat(part("p_partkey"), F.lit("\n// gap\n"), part("p_partkey * 2 + 1")), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return local_flow.flows(spread(spark, d, "part", "p_partkey").select(F.concat(F.lit("p"), "p_partkey", F.lit(".c")).alias("path"), text.alias("content")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MIT and gpl-3.0' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'LGPL' ELSE 'General Public License' END WHEN 2 THEN 'Apache' END AS licence,
    CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'MEDIUM' END END AS risk FROM part""")
def j26_licence_files(spark, d):
    """A licence that is told, or read from the folder's licence file: the first of its kinds by name."""
    rows = read(spark, d, "part")
    deps = rows.select("p_partkey", F.expr("'n' || p_partkey").alias("name"), F.lit("1").alias("version"), F.expr("'d/' || p_partkey || '/package.json'").alias("source_file"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'MIT and gpl-3.0' WHEN 1 THEN '' WHEN 2 THEN 'Apache' END").alias("licence"))
    own = rows.filter("p_partkey % 4 = 1")
    files = own.select(F.expr("'d/' || p_partkey || '/COPYING'").alias("path"), F.lit("GNU General Public License").alias("content"))
    files = files.union(own.filter("p_partkey % 8 = 1").select(F.expr("'d/' || p_partkey || '/LICENSE.md'"), F.lit("under LGPL 2")))
    files = files.union(rows.filter("p_partkey % 4 = 3").select(F.expr("'d/' || p_partkey || '/LICENSE'"), F.concat(F.repeat(F.lit(" "), F.lit(600)), F.lit("AGPL"))))
    return supply.licensed(deps, files).select("p_partkey", "licence", "risk")


@query("""SELECT 'N' || p_partkey AS name, p_size::VARCHAR AS version, 'npm' AS ecosystem, CASE WHEN p_partkey % 2 = 0 THEN 'CVE-' || p_partkey ELSE 'ID-' || p_partkey END AS cve, 'No description available.' AS summary,
    CASE WHEN p_partkey % 10 >= 9 THEN 'CRITICAL' WHEN p_partkey % 10 >= 7 THEN 'HIGH' WHEN p_partkey % 10 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, (p_partkey % 10)::DOUBLE AS cvss, '9.' || p_partkey AS fixed
    FROM part WHERE p_partkey % 3 = 0""")
def j25_s18_advisories(spark, d):
    """A table of advisories in place of a service; unpinned packages and other versions or ecosystems have none."""
    rows = read(spark, d, "part")
    deps = rows.select(F.expr("'N' || p_partkey").alias("name"), F.expr("if(p_partkey % 3 = 1, null, cast(p_size as string))").alias("version"), F.lit("npm").alias("ecosystem"))
    told = rows.select(
        F.lit("npm").alias("ecosystem"), F.expr("'n' || p_partkey").alias("name"), F.expr("if(p_partkey % 3 = 2, 'x', cast(p_size as string))").alias("version"), F.expr("'ID-' || p_partkey").alias("id"),
        F.expr("if(p_partkey % 2 = 0, array('GHSA-1', 'CVE-' || p_partkey), array('GHSA-1'))").alias("aliases"), F.lit(None).cast("string").alias("summary"),
        F.expr("array('CVSS:3.1/AV:N/' || p_partkey % 10 || '.0')").alias("scores"), F.expr("array(struct('other' AS name, array('1') AS fixed), struct('N' || p_partkey AS name, array('9.' || p_partkey) AS fixed))").alias("affected"),
    )
    return supply.advised(deps, told)


_CODE = [
    ("a /* x */ b", "a         b"), ("a // x", "a     "), ("/* {k}\n y */z", None), ("plain {k}", "plain {k}"), ("/* open {k}", "/* open {k}"), ("", ""),
]


@query(f"""WITH c(n, masked) AS (VALUES {values([(n, m) for n, (_, m) in enumerate(_CODE)])}) SELECT p_partkey, n, CASE WHEN n = 2 THEN repeat(' ', 3 + length(p_partkey::VARCHAR)) || chr(10) || '     z'
    ELSE replace(masked, '{{k}}', p_partkey::VARCHAR) END AS masked FROM part, c""")
def f8_masked_comments(spark, d):
    texts = [F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string")) for t, _ in _CODE]
    rows = read(spark, d, "part").select("p_partkey", F.posexplode(F.array(*texts)).alias("n", "t"))
    return rows.select("p_partkey", "n", triage.masked(F.col("t")).alias("masked"))


_ARGUMENTS = [("a, f(b, c)[1, 2], {d, {k}}", "a|f(b, c)[1, 2]|{d, {k}}"), ("", ""), (" x ", "x"), (",,y{k},", "y{k}")]


@query(f"WITH c(n, a) AS (VALUES {values([(n, a) for n, (_, a) in enumerate(_ARGUMENTS)])}) SELECT p_partkey, n, replace(a, '{{k}}', p_partkey::VARCHAR) AS arguments FROM part, c")
def f9_arguments(spark, d):
    texts = [F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string")) for t, _ in _ARGUMENTS]
    rows = read(spark, d, "part").select("p_partkey", F.posexplode(F.array(*texts)).alias("n", "t"))
    return rows.select("p_partkey", "n", F.concat_ws("|", triage.arguments(F.col("t"))).alias("arguments"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey * 16 + 15 WHEN 2 THEN -p_partkey END::BIGINT AS value FROM part")
def f20_constants(spark, d):
    told = F.expr("CASE p_partkey % 5 WHEN 0 THEN p_partkey || 'UL' WHEN 1 THEN ' 0x' || lower(hex(p_partkey)) || 'F ' WHEN 2 THEN '-' || p_partkey WHEN 3 THEN 'n + ' || p_partkey END")
    return read(spark, d, "part").select("p_partkey", triage.constant(told).alias("value"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def f26_escaped(spark, d):
    return read(spark, d, "pages").select("page_id", triage.escaped(F.col("html")).alias("escaped"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 'own-' || p_partkey END AS owner, CASE WHEN p_partkey % 5 < 4 THEN 'n.' || p_size END AS name FROM part")
def s16_repositories(spark, d):
    at = "'own-' || p_partkey || '/n.' || p_size"
    told = F.expr(f"CASE p_partkey % 5 WHEN 0 THEN 'https://example.com/' || {at} || '/tree/x' WHEN 1 THEN 'git@example.com:' || {at} || '.git' WHEN 2 THEN {at} WHEN 3 THEN ' http://x/' || {at} || '.git ' ELSE 'alone' END")
    parts = triage.repository(told)
    return read(spark, d, "part").select("p_partkey", parts["owner"].alias("owner"), parts["name"].alias("name"))


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber * (l_partkey % 5))::BIGINT AS lo, CASE WHEN l_suppkey % 7 = 0 THEN CASE WHEN l_quantity::BIGINT = 0 THEN 0 END ELSE l_quantity::BIGINT * (l_suppkey % 50) END::BIGINT AS hi FROM lineitem""")
def f19_products(spark, d):
    a = intervals.interval(F.col("l_linenumber"), F.col("l_quantity"))
    b = intervals.interval(F.expr("l_partkey % 5"), F.expr("if(l_suppkey % 7 > 0, l_suppkey % 50, null)"))
    product = intervals.multiplied(a, b)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", product["lo"].alias("lo"), product["hi"].alias("hi"))
