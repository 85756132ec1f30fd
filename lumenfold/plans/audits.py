"""Queries of the rule scanners, tool reports, coverage, reports and import graphs, each with the SQL that checks it.

The tables hold prose, so files are made from rows: each row of `part` becomes a file of samples of a language, chosen and
filled by the row's numbers. The SQL finds the samples by the rules' patterns one by one and knows their lines from what
stands before them, so that it says what a scan of the whole file must find, by another way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import graphs, imports, owasp, relations, reports, scan
from lumenfold.operators.rules import COMPOSE, CONTAINER, ENDED, INFRASTRUCTURE, OFFICIAL, TAINT
from lumenfold.plans.registry import query, read, spread, values
from lumenfold.sources import tools

#: Samples that a file has, and how the j-th of a file is chosen.
PLACES = 6
_CHOICE = "(p_partkey * (j + 3) + j * 7) % {n}"

C = [
    "char *p{k} = calloc(n * {k}, 4);", "int x = 1;", "for (i = 0; i <= 64; i++) a[i] = {k};", "char c = x + {k};", "q = realloc(q, {k});",
    "strncat(dst, src, {k});", "memcpy(dst, src, len{k});", "system(cmd{k});", 'f = fopen("fixed{k}.txt", "r");', "f = fopen(name{k}, mode);",
    "tmpnam(buf); // {k}", "srand({k}); z = rand();", "int i{k} = read_it();\nbuf[i{k}] = 0", "for (i = 0; i <= dev->slot_count; i++) use({k});",
    "for (i = 0; i <= MAX_PORTS; i++) use({k});", "n = static_cast<uint16_t>(sizeof(x) * {k});", "ring[irq_head] = {k};",
    "for (i = 0; i < dev->io_count; i++) go({k});", "free(p);", "free(q{k});", "free(p); // {k}", "std::malloc(n)\nk = {k}\nmemcpy(a, b, 9)",
    "b = malloc(n);\n\tz = {k}\n\tmemcpy(b, src, 4)", "return {k};",
]
PYTHON = [
    'cur.execute("select %s" % x{k})', "cur.execute('select {k}'.format(x))", 'cur.execute(f"select {k}")', "os.system(cmd{k})", "subprocess.run(cmd{k}, shell=True)",
    "subprocess.run(cmd{k})", "eval(text{k})", "pickle.loads(blob{k})", "yaml.load(text{k})", "import xml.dom.minidom as m{k}", "Api_Key = 'abcd{k}'", "open(os.path.join(a, b{k}))",
    "requests.get(url{k})", "requests.get('http://x/{k}')", "hashlib.md5(b{k})", "app.run(port={k}, debug=True)", "render_template_string(t{k})", "Template('fixed{k}')",
    "random.randint(0, {k})", "jwt.decode(t, algorithms=['none'], k={k})", "app.add_url_rule('/{k}/.**')", "<!ENTITY x{k} SYSTEM 'f'>", "x = {k}", "  \tos.system(a); eval(b{k})",
]
JAVA = [
    'Statement.execute("a" + b{k});', "c.createStatement( );", "Runtime.getRuntime().exec (cmd{k});", "new ObjectInputStream(in{k});", "new File(name{k});", 'new File("fixed{k}");',
    "SAXParserFactory.newInstance(); // {k}", 'MessageDigest.getInstance("MD5"); // {k}', 'String password = "abcd{k}";', "new InitialDirContext(env{k});", "new StandardEvaluationContext(); // {k}",
    'response.sendRedirect(request.getParameter("u{k}"));', "new Random({k});", 'String v = request.getParameter("a{k}");', "int x = {k};",
]
GO = [
    "db.Query(fmt.Sprintf(q, {k}))", 'db.Query("select {k}")', 'exec.Command("a" + b{k})', "os.Open(name{k})", "InsecureSkipVerify: true, // {k}", "h := md5.New() // {k}", 'token := "abcd{k}"',
    "go func() { work({k}) }()", 'http.Redirect(w, r, r.FormValue("u{k}"), 302)', "http.Get(url{k})", 'http.Get("https://x/{k}")', "ch := make(chan int) // {k}", "n := int(a{k}) * int(b)", "x := {k}",
]
RUST = [
    "unsafe { poke({k}) }", "let p = x as *const u8; // {k}", "fn f(p: *mut T{k}) {}", "v.unwrap(); // {k}", 'v.expect("{k}");', "std::mem::transmute(x{k});", "extern crate md5; // {k}",
    'const TOKEN: &str = "abcd{k}";', 'Command::new(format!("{}", x{k}));', "let x = {k};",
]
TERRAFORM = [
    'acl = "public-read"', 'acl = "public-read-write"', 'ingress {\n  from = {k}\n  cidr_blocks = [ "0.0.0.0/0" ]\n}', 'ingress {\n  cidr_blocks = ["10.0.0.0/8"]\n}', "from_port = 0 to_port = 65535 # {k}",
    "encrypted = false", "versioning {\n  enabled = false\n}", "versioning {\n  enabled = true\n}", "logging { }", 'secret = "abcd{k}"', "publicly_accessible = true", 'protocol = "-1"',
    "deletion_protection = false", "multi_az = false", 'ssl_policy = "ELBSecurityPolicy-2016-08"', "enable_key_rotation = false", "count = {k}",
]
KUBERNETES = [
    "privileged: true", "runAsUser: 0", "runAsUser: 0{k}", "allowPrivilegeEscalation : true", "readOnlyRootFilesystem: false", "hostNetwork: true", "hostPID: true", "image: app{k}:latest",
    "capabilities:\n  add:\n    - SYS_ADMIN", "capabilities:\n  drop:\n    - ALL", "type: NodePort", "limits: {}", "limits:\n  cpu: {k}", "automountServiceAccountToken: true", "replicas: {k}",
]
DOCKER = [
    "FROM app{k}:latest", "USER root", "env TOKEN=abc{k}", "ADD https://x/{k} /y", "RUN apt-get install a{k}", "RUN apt-get install --no-install-recommends a{k}", "EXPOSE 22", "COPY . .",
    "RUN chmod 777 /x{k}", "RUN x --security-opt seccomp=unconfined", "WORKDIR /x{k}",
]
CLOUDFORMATION = [
    "BlockPublicAcls: false", "CidrIp: 0.0.0.0/0", 'SSEAlgorithm: "none"', "PubliclyAccessible: true", "DeletionPolicy: Delete", "DeletionPolicy: Retain", 'MultiAZ: "false"', "Size: {k}",
]
ANSIBLE = [
    "password: 'abcd{k}'", 'password: "{{ vault_{k} }}"', "become: yes", "become: yes become_user: app{k}", "shell: curl http://x/{k} | sh", "mode: 0777", "mode: '0644'", "name: t{k}",
]
DOCKERFILE = [
    "FROM python:3.6", "from ubuntu:14.04.5 AS base{k}", "FROM store/node:14.2", "FROM --platform=linux/amd64 alpine", "FROM app{k}@sha256:abc{k}", "  USER root", "USER app{k}", "RUN run --privileged {k}",
    "RUN chmod 666 /x{k}", "ADD http://x/{k} /", "RUN curl -s x/{k} | bash", "RUN wget x/{k} | sh", "RUN npm install a --unsafe-perm", "EXPOSE 22", "EXPOSE 5432", "COPY a{k}.pem /", "ENV MY_TOKEN={k}",
    "RUN apt-get update", "RUN apt-get install --no-install-recommends a && rm -rf /x", "HEALTHCHECK NONE", "HEALTHCHECK CMD x{k}", "WORKDIR /x",
]
COMPOSED = [
    "privileged: true", 'network_mode: "host"', "pid: host", "ipc: 'host'", "cap_add: [ALL]", "volumes: [ './x:/etc/x{k}' ]", "volumes: [ './x:/data{k}' ]", "image: a{k}",
]

#: Patterns with look-ahead in the words of an engine that has none, and what must not match besides.
_PLAIN = {
    "C09": (r'\bfopen\s*\(\s*[^"\s]', None),
    "PY04": (r"\bpickle\.loads?\s*\(|\byaml\.load\s*\([^)]+\)", r"\)\s*,\s*Loader"),
    "PY08": (r"""\brequests\.(get|post|put|delete)\s*\(\s*([^"'\s]|["'][^h])""", None),
    "PY11": (r"""render_template_string\s*\(|Template\s*\(\s*[^"'f\s]""", None),
    "JV05": (r"""new\s+File\s*\(\s*[^"'\s]""", None),
    "GO09": (r"""http\.(?:Get|Post)\s*\(\s*[^"'\s]""", None),
    "K8S010": (r"(?:limits|requests)\s*:", r"(?:limits|requests)\s*:\s*\n\s+(?:cpu|memory)"),
    "DF005": (r"(?i)apt-get\s+install", r"(?i)apt-get\s+install.*--no-install-recommends"),
    "ANS001": (r"""(?:password|secret|token)\s*:\s*(?:'[^"']{4,}|"[^"'{]{4,})""", None),
    "ANS002": (r"become\s*:\s*(?:yes|true)", r"become_user"),
    "CONT-BP-002": (r"apt-get\s+(?:install|update)", r"--no-install-recommends"),
    "CONT-BP-003": (r"apt-get\s+(?:update|install)", r"&&\s*(?:rm|apt-get clean)"),
}


def _numbers(rules: list) -> list[tuple]:
    return [(n, r[0], r[1], r[2], *_PLAIN.get(r[0], (r[-1], None))) for n, r in enumerate(rules, 1)]


def _chosen(samples: list[str], separator: str) -> str:
    """p(k, j, e, line): the samples of each row's file, with the line that each begins at."""
    n = len(samples)
    return f"""els(i, e) AS (VALUES {values(list(enumerate(samples)))}),
      s AS (SELECT p_partkey AS k, j, replace(e, '{{k}}', p_partkey::VARCHAR) AS e FROM part, range({PLACES}) t(j), els WHERE i = {_CHOICE.format(n=n)}),
      p AS (SELECT *, 1 + coalesce(sum(length(e) - length(replace(e, chr(10), '')) + {1 + bool(separator)}) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS line FROM s)"""


def _made(spark: SparkSession, d: str, samples: list[str], separator: str, name: str) -> DataFrame:
    """path, content: a file for each row of part."""
    every = F.array(*map(F.lit, samples))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda j: F.get(every, ((F.col("p_partkey") * (j + 3) + j * 7) % len(samples)).cast("int")))
    between = f"\n{separator}\n" if separator else "\n"
    text = F.replace(F.concat_ws(between, chosen), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return spread(spark, d, "part", "p_partkey").select(F.format_string(name, F.col("p_partkey")).alias("path"), text.alias("content"))


def _sql_scan(samples: list[str], separator: str, name: str, rules: list, once: bool, free: bool = False) -> str:
    twice = """ UNION ALL SELECT k, line, 0, 'C02', 'double-free', 'HIGH', e FROM (SELECT *, row_number() OVER (PARTITION BY k, regexp_extract(e, 'free\\(([a-z0-9]+)\\)', 1) ORDER BY j) AS n
      FROM p WHERE regexp_matches(e, '\\bfree\\(')) WHERE n > 1"""
    first = " QUALIFY row_number() OVER (PARTITION BY k, issue, line ORDER BY ord) = 1" if once else ""
    before, after = name.split("%d")
    return f"""WITH {_chosen(samples, separator)}, rules(ord, id, issue, severity, pattern, unless) AS (VALUES {values(_numbers(rules))}),
      hits AS (SELECT k, line, ord, id, issue, severity, e FROM p, rules WHERE regexp_matches(e, pattern) AND (unless IS NULL OR NOT regexp_matches(e, unless)){twice if free else ''})
      SELECT '{before}' || k || '{after}' AS path, line, id AS rule_id, issue, severity, trim(replace(string_split(e, chr(10))[1], chr(9), ' ')) AS snippet FROM hits{first}"""


_FOUND = ["path", "line", "rule_id", "issue", "severity", "snippet"]


def _taint(name: str, samples: list[str], separator: str, language: str, ending: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scan.taint(_made(spark, d, samples, separator, f"src/p%d{ending}")).select(*_FOUND)

    run.__name__ = name
    query(_sql_scan(samples, separator, f"src/p%d{ending}", TAINT[language], True, language == "c"))(run)


_taint("d1_c_rules", C, ";", "c", ".c")
_taint("d2_python_rules", PYTHON, "#", "python", ".PY")
_taint("d3_java_rules", JAVA, "//", "java", ".java")
_taint("d4_go_rules", GO, "//", "go", ".go")
_taint("d5_rust_rules", RUST, "//", "rust", ".rs")

#: Framework -> samples, what stands between them, name and beginning of a made file.
_INFRA = {
    "terraform": (TERRAFORM, "#", "t%d.tf", ""),
    "kubernetes": (KUBERNETES, "#", "k%d.yaml", "apiVersion: v1\nkind: Pod\n"),
    "docker": (DOCKER, "#", "Dockerfile.%d", ""),
    "cloudformation": (CLOUDFORMATION, "#", "c%d.yml", "AWSTemplateFormatVersion: 1\n"),
    "ansible": (ANSIBLE, "#", "a%d.yml", "hosts: all\ntasks: x\n"),
}


def _sql_infrastructure() -> str:
    """Each framework's own scan; docker's patterns ignore case."""
    out = []
    for kind, (samples, separator, name, head) in _INFRA.items():
        told = _sql_scan(samples, separator, name, INFRASTRUCTURE[kind], False)
        out.append(f"SELECT path, line + {head.count(chr(10))} AS line, rule_id, issue, severity, snippet, '{kind}' AS kind FROM ({told})")
    return " UNION ALL ".join(out)


@query(_sql_infrastructure())
def d17_infrastructure_rules(spark, d):
    """Files of five frameworks, told apart by name and content, in one scan."""
    files = None
    for samples, separator, name, head in _INFRA.values():
        more = _made(spark, d, samples, separator, name).withColumn("content", F.concat(F.lit(head), "content"))
        files = more if files is None else files.union(more)
    return scan.infrastructure(files).select(*_FOUND, "kind")


def _lined(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.split(scan.plain(F.col("content")), "\n")).alias("at", "text"))
    return rows.select("path", (F.col("at") + 1).alias("line"), "text")


_IMAGE = "regexp_extract(e, '(?i)^FROM +(?:--platform=[^ ]+ +)?([^ :@]+)(?::([^ @]+))?(?:@(sha256:[a-z0-9]+))?', {n})"
_SQL_IMAGES = f"""i AS (SELECT *, {_IMAGE.format(n=1)} AS image, {_IMAGE.format(n=2)} AS tag0, {_IMAGE.format(n=3)} AS digest FROM p WHERE regexp_matches(e, '(?i)^FROM ')),
    g AS (SELECT k, line, e, image, coalesce(nullif(tag0, ''), 'latest') AS tag, tag0 = '' AND digest = '' AS bare, digest <> '' AS pinned, regexp_extract(image, '([^/]*)$', 1) AS base FROM i),
    ended(name, sev) AS (VALUES {values(list(ENDED.items()))}),
    o AS (SELECT g.*, f.sev AS full_sev, coalesce(f.sev, m.sev) IS NOT NULL AS old FROM g LEFT JOIN ended f ON f.name = base || ':' || tag LEFT JOIN ended m ON m.name = base || ':' || split_part(tag, '.', 1))"""


@query(f"""WITH {_chosen(DOCKERFILE, '')}, {_SQL_IMAGES},
    rules(ord, id, category, severity, pattern, unless) AS (VALUES {values(_numbers(CONTAINER))}),
    cwes(id, cwe) AS (VALUES {values([(r[0], r[3]) for r in CONTAINER])}),
    h AS (SELECT k, line, r.id AS rule_id, category, severity, cwe, trim(e) AS snippet FROM p, rules r JOIN cwes USING (id) WHERE regexp_matches(trim(e), '(?i)' || pattern) AND (unless IS NULL OR NOT regexp_matches(e, unless))
      UNION ALL SELECT k, line, 'CONT-BP-001', 'base-image', 'info', 'CWE-1104', e FROM o WHERE bare
      UNION ALL SELECT k, line, 'CONT-IMG-001', 'base-image', coalesce(full_sev, 'high'), 'CWE-1104', e FROM o WHERE old
      UNION ALL SELECT k, line, 'CONT-IMG-002', 'base-image', 'medium', 'CWE-1104', e FROM o WHERE NOT pinned
      UNION ALL SELECT k, 1, 'CONT-PRIV-004', 'privilege', 'high', 'CWE-250', '(missing USER instruction)' FROM p GROUP BY k HAVING NOT bool_or(trim(e) ILIKE 'user %' AND NOT e ILIKE '%root%')
      UNION ALL SELECT k, 1, 'CONT-BP-005', 'base-image', 'info', '', '(missing HEALTHCHECK)' FROM p GROUP BY k HAVING NOT bool_or(trim(e) ILIKE 'healthcheck%'))
    SELECT 'Dockerfile.' || k AS path, line, rule_id, category, severity, cwe, snippet FROM h""")
def d18_container_rules(spark, d):
    return scan.dockerfiles(_lined(_made(spark, d, DOCKERFILE, "", "Dockerfile.%d")))


@query(f"""WITH {_chosen(DOCKERFILE, '')}, {_SQL_IMAGES}
    SELECT 'Dockerfile.' || k AS path, line, image, tag, pinned, base IN ({', '.join(map(repr, OFFICIAL))}) OR NOT contains(image, '/') AS official, old AS ended FROM o""")
def f14_from_lines(spark, d):
    return scan.base_images(_lined(_made(spark, d, DOCKERFILE, "", "Dockerfile.%d"))).select("path", "line", "image", "tag", "pinned", "official", "ended")


@query(f"""WITH {_chosen(COMPOSED, '')}, rules(ord, id, category, severity, pattern, unless) AS (VALUES {values(_numbers(COMPOSE))}), cwes(id, cwe) AS (VALUES {values([(r[0], r[3]) for r in COMPOSE])})
    SELECT 'docker-compose.yml/' || k AS path, line, r.id AS rule_id, category, severity, cwe, e AS snippet FROM p, rules r JOIN cwes USING (id) WHERE regexp_matches(e, '(?i)' || pattern)""")
def d19_compose_rules(spark, d):
    return scan.compose_files(_lined(_made(spark, d, COMPOSED, "", "docker-compose.yml/%d")))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'c' WHEN 1 THEN 'c' WHEN 2 THEN 'python' WHEN 3 THEN 'rust' END AS language,
    CASE page_id % 6 WHEN 0 THEN NULL WHEN 4 THEN 'docker' WHEN 5 THEN 'cloudformation' END AS framework FROM pages""")
def s12_p15_languages_and_frameworks(spark, d):
    path = F.expr("CASE page_id % 6 WHEN 0 THEN 'a.b/X.HPP' WHEN 1 THEN 'y.c' WHEN 2 THEN '/r/z.Py' WHEN 3 THEN 'lib.rs' WHEN 4 THEN 'x.d/Dockerfile' || page_id ELSE 'stack' || page_id || '.json' END")
    content = F.expr("if(page_id % 6 = 5, '{\"AWSTemplateFormatVersion\": 1}', html)")
    return read(spark, d, "pages").select("page_id", scan.language(path).alias("language"), scan.framework(path, content).alias("framework"))


# reports of other tools: each row of events is a report of three results


def _reports(spark: SparkSession, d: str, made: str) -> DataFrame:
    return read(spark, d, "events").select(F.expr("'f' || event_id || '.c'").alias("path"), F.expr(made).alias("content"))


_BANDIT_IDS = ["B102", "B602", "B608", "B999", "B303"]


@query(f"""WITH ids(n, id, issue) AS (VALUES {values([(n, i, tools.BANDIT.get(i, 'os-injection')) for n, i in enumerate(_BANDIT_IDS)])})
    SELECT 'f' || event_id || '.c' AS path, (event_id % 50)::INT AS line, issue, 'code ' || event_id AS snippet, 'first' AS message FROM events JOIN ids ON n = event_id % 5
    UNION ALL SELECT 'f' || event_id || '.c', NULL, 'os-injection', '', '' FROM events""")
def s31_j5_bandit(spark, d):
    """The second result repeats the first's issue and line; the third has neither id nor line."""
    ids = "element_at(array(" + ", ".join(f"'{i}'" for i in _BANDIT_IDS) + "), cast(event_id % 5 + 1 as int))"
    made = f"""concat('{{"results": [{{"test_id": "', {ids}, '", "line_number": ', event_id % 50, ', "issue_text": "first", "code": " code ', event_id, '\\\\n"}}, {{"test_id": "', {ids},
      '", "line_number": ', event_id % 50, ', "issue_text": "again"}}, {{}}]}}')"""
    return tools.bandit(_reports(spark, d, made))


_CHECKS = ["bugprone-use-after-move", "cert-err34-c", "clang-analyzer-unix.Malloc.More", "misc-other"]
_SQL_TIDY = [("use-after-free",), ("integer-overflow",), ("heap-buffer-overflow",), ("misc-other",)]


@query(f"""WITH t(n, tidy) AS (VALUES {values([(n, v[0]) for n, v in enumerate(_SQL_TIDY)])})
    SELECT 'f' || event_id || '.c' AS path, 7 AS line, CASE WHEN event_id % 2 = 0 THEN 'null-pointer' ELSE 'odd' || event_id END AS issue, 'HIGH' AS severity, 'CWE-476' AS cwe, 'cppcheck' AS tool FROM events
    UNION ALL SELECT 'f' || event_id || '.c', 0, 'memory-leak', 'LOW', '', 'cppcheck' FROM events
    UNION ALL SELECT 'f' || event_id || '.c', 9, tidy, 'MEDIUM', 'CWE-12', 'clang-tidy' FROM events JOIN t ON n = event_id % 4
    UNION ALL SELECT 'f' || event_id || '.c', 9, 'insecure-eval', 'MEDIUM', '', 'semgrep' FROM events
    UNION ALL SELECT 'f' || event_id || '.c', 11, 'division-by-zero', 'HIGH', '', 'infer' FROM events""")
def s30_j5_p17_tools(spark, d):
    """Reports of four tools for each file; noise and what an earlier tool has told is left out."""
    xml = """concat('<results version="2"><errors><error id="', if(event_id % 2 = 0, 'nullPointer', 'odd' || event_id), '" severity="error" msg="m" cwe="476"><location file="f', event_id,
      '.c" line="7" column="1"/><location file="g.c" line="1"/></error><error id="memleak" severity="style" msg="n"/><error id="toomanyconfigs" severity="style" msg="x"/>',
      '<error id="z" severity="information" msg="x"/></errors></results>')"""
    checks = "element_at(array(" + ", ".join(f"'{i}'" for i in _CHECKS) + "), cast(event_id % 4 + 1 as int))"
    tidy = f"""concat('noise\\nf', event_id, '.c:9:3: warning: see cwe-12 here [', {checks}, ']\\r\\nf', event_id, '.c:10:3: error: y [clang-diagnostic-x]\\n')"""
    semgrep = """concat('{"results": [{"check_id": "py.Eval.x', event_id, '", "extra": {"message": "m", "severity": "WARNING"}, "start": {"line": 9}}]}')"""
    infer = """'[{"bug_type": "DIVIDE_BY_ZERO", "line": 11, "qualifier": "q"}, {"bug_type": "MEMORY_LEAK", "line": 0}]'"""
    found = [read_(_reports(spark, d, made)) for read_, made in ((tools.cppcheck, xml), (tools.clang_tidy, tidy), (tools.semgrep, semgrep), (tools.infer, infer))]
    return tools.merged(found).select("path", "line", "issue", "severity", "cwe", "tool")


_SARIF = """concat('{"runs": [{"results": [{"ruleId": "CWE-', event_id % 9 + 1, '", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/a', event_id, '.c"}, "region": {"startLine": 5}}}]},
  {"ruleId": "x", "properties": {"cwe": "89"}, "codeFlows": [{"threadFlows": [{"locations": [{"location": {"physicalLocation": {"artifactLocation": {"uri": "b.c"}, "region": {"startLine": 6}}}}]}]}]},
  {"kind": "pass", "ruleId": "CWE-1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "p.c"}, "region": {"startLine": 1}}}]},
  {"taxa": [{"id": "22", "toolComponent": {"name": "CWE"}}], "locations": [{"physicalLocation": {"artifactLocation": {"uri": "t.c"}, "region": {"startLine": 8}}}]},
  {"message": {"text": "as cwe-', event_id, ' says"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "m.c"}, "region": {"startLine": 9}}}, {"physicalLocation": {"artifactLocation": {"uri": "m.c"}}}]},
  {"message": {"text": "nothing"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "n.c"}, "region": {"startLine": 9}}}]}]}]}')"""
_SQL_SARIF = """s AS (SELECT 'f' || event_id || '.c' AS suite, 'CWE-' || event_id % 9 + 1 AS cwe, 'a' || event_id || '.c' AS file, 5 AS line, event_id FROM events
    UNION ALL SELECT 'f' || event_id || '.c', 'CWE-89', 'b.c', 6, event_id FROM events UNION ALL SELECT 'f' || event_id || '.c', 'CWE-22', 't.c', 8, event_id FROM events
    UNION ALL SELECT 'f' || event_id || '.c', 'CWE-' || event_id, 'm.c', 9, event_id FROM events)""".replace("'CWE-' || event_id % 9 + 1", "'CWE-' || (event_id % 9 + 1)")


@query(f"WITH {_SQL_SARIF} SELECT suite, cwe, file, line FROM s")
def s29_sarif(spark, d):
    return tools.sarif(_reports(spark, d, _SARIF))


@query(f"""WITH {_SQL_SARIF}, p AS (SELECT suite, CASE WHEN file = 'b.c' THEN 'CWE-7' ELSE cwe END AS cwe, file, CASE WHEN file = 't.c' THEN 88 ELSE line END AS line FROM s)
    SELECT s.suite, s.cwe, s.file, s.line, CASE file WHEN 'b.c' THEN 'mismatch' WHEN 't.c' THEN 'miss' ELSE 'match' END AS kind, CASE WHEN file = 'b.c' THEN 'CWE-7' END AS got FROM s
    UNION ALL SELECT suite, cwe, file, line, 'extra', NULL FROM p WHERE file IN ('b.c', 't.c')""")
def j33_explained(spark, d):
    truth = tools.sarif(_reports(spark, d, _SARIF))
    pred = truth.withColumns({"cwe": F.expr("if(file = 'b.c', 'CWE-7', cwe)"), "line": F.expr("if(file = 't.c', 88, line)")})
    return tools.explained(truth, pred)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CWE-' || event_id WHEN 1 THEN 'CWE-12' ELSE '' END AS cwe FROM events""")
def p3_cwe_in_text(spark, d):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN 'see cwe-' || event_id || ', CWE-1' WHEN 1 THEN 'xCWE-12y' WHEN 2 THEN 'CWE 5' END")
    return read(spark, d, "events").select("event_id", tools.cwe_in(text).alias("cwe"))


# coverage of categories

_WEAK = [("CWE-22", "A01"), ("CWE-798", "A07"), ("CWE-89", "A03"), ("CWE-918", "A10")]
_KINDS = ["click", "error", "purchase", "signup", "view"]
_ISSUES = [("CWE-22", "path-traversal", "HIGH", ""), ("89 ", "x", "low", "query"), ("", "weak thing", "Medium", "uses MD5 hash"), ("CWE-9999", "none", "HIGH", "nothing known"), ("", "ssrf", "odd", "Server.Side Request")]
_SQL_ISSUES = f"""i(kind, cwe, issue, severity, description) AS (VALUES {values([(k, *v) for k, v in zip(_KINDS, _ISSUES)])}),
    words(n, word, category) AS (VALUES {values([(n, *w) for n, w in enumerate(owasp.WORDS)])}), weak(weakness, category) AS (VALUES {values(_WEAK)}),
    told AS (SELECT i.*, coalesce((SELECT category FROM weak WHERE weakness = CASE WHEN upper(trim(cwe)) LIKE 'CWE-%' THEN upper(trim(cwe)) ELSE 'CWE-' || upper(trim(cwe)) END),
      (SELECT arg_min(category, n) FROM words WHERE contains(lower(issue || ' ' || description), word))) AS category FROM i),
    f AS (SELECT event_id, told.* FROM events JOIN told ON kind = event_type)"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    told = spark.createDataFrame([(k, *v) for k, v in zip(_KINDS, _ISSUES)], "event_type string, cwe string, issue string, severity string, description string")
    rows = read(spark, d, "events").select("event_id", "event_type").join(F.broadcast(told), "event_type")
    return owasp.mapped(rows, spark.createDataFrame(_WEAK, "weakness string, category string"))


@query(f"""WITH {_SQL_ISSUES} SELECT c.key, c.id, c.name, count(event_id) AS n, {', '.join(f"count(*) FILTER (lower(severity) = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low', 'info'))},
    coalesce(min(event_id), 0) AS first_sample, least(count(event_id), 3) AS n_samples FROM (VALUES {values(owasp.CATEGORIES)}) c(key, id, name) LEFT JOIN f ON f.category = c.key GROUP BY ALL""")
def a7_ten_categories(spark, d):
    rows = owasp.coverage(_issues(spark, d).withColumn("issue", F.col("event_id").cast("string")), ["event_id"])
    samples = F.coalesce(F.size("samples"), F.lit(0))
    first = F.coalesce(F.get("samples", F.lit(0))["issue"].cast("long"), F.lit(0))
    return rows.withColumns({"first_sample": first, "n_samples": F.when(samples < 0, 0).otherwise(samples)}).drop("samples")


@query(f"""WITH {_SQL_ISSUES} SELECT count(*) AS total, count(category) AS mapped, count(*) - count(category) AS unmapped, count(DISTINCT category) * 10.0::DOUBLE AS coverage_pct FROM f""")
def x11_coverage_totals(spark, d):
    return owasp.totals(_issues(spark, d))


# whole reports, read back field by field


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the rules on made files, as reports take them."""
    told = scan.taint(_made(spark, d, PYTHON, "#", "src/p%d.py"))
    return told.withColumns({"confidence": F.lit("High"), "note": F.expr("if(severity = 'LOW', '', 'seen by ' || rule_id)"), "stage": F.expr("if(severity = 'HIGH', 'Taint', 'Other')"), "cwe": F.lit(""), "description": F.lit("d")})


_INTEL = [("os-command-injection", "CWE-78", "CVE-1", 9.8, "commands", "quote"), ("insecure-eval", "CWE-95", "", 7.5, "code", None)]
_SQL_PY = f"f AS ({_sql_scan(PYTHON, '#', 'src/p%d.py', TAINT['python'], True)})"


@query(f"""WITH {_SQL_PY} SELECT path, count(*) AS n_results, count(DISTINCT issue) AS n_rules, arg_min(issue, (line, issue)) AS first_rule, min(line) AS first_line,
    list(CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END ORDER BY line, issue)::VARCHAR AS levels,
    coalesce(max(CASE WHEN issue = 'os-command-injection' THEN 'CWE-78,CVE-1' END), '') AS tags,
    arg_min(list_aggregate(list_transform(string_split(issue, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' detected (confidence: High)' || CASE WHEN severity = 'LOW' THEN '' ELSE ' \u2014 seen by ' || rule_id END, (line, issue)) AS message,
    '2.1.0' AS version FROM f GROUP BY path""")
def k3_sarif_documents(spark, d):
    """A log for each file, parsed again."""
    intel = spark.createDataFrame(_INTEL, "issue string, cwe string, cve string, cvss double, description string, fix string")
    told = reports.sarif_documents(_findings(spark, d).drop("cwe", "description"), intel, "path")
    result = "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<region:struct<startLine:int>>>>>"
    kind = f"version string, runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>>>>>>,results:array<{result}>>>"
    run = F.get(F.from_json("document", kind)["runs"], F.lit(0))
    rows = told.select("path", run["results"].alias("r"), run["tool"]["driver"]["rules"].alias("rules"), F.from_json("document", kind)["version"].alias("version"))
    first = F.get("r", F.lit(0))
    own = F.get(F.filter("rules", lambda x: x["id"] == "os-command-injection"), F.lit(0))
    return rows.select(
        "path", F.size("r").alias("n_results"), F.size("rules").alias("n_rules"), first["ruleId"].alias("first_rule"),
        F.get(first["locations"], F.lit(0))["physicalLocation"]["region"]["startLine"].alias("first_line"),
        F.concat(F.lit("["), F.concat_ws(", ", F.transform("r", lambda x: x["level"])), F.lit("]")).alias("levels"),
        F.coalesce(F.concat_ws(",", own["properties"]["tags"]), F.lit("")).alias("tags"), first["message"]["text"].alias("message"), "version",
    )


@query(f"""WITH {_SQL_PY} SELECT path, 1 AS files, count(*) AS n, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'LOW') AS low,
    count(*) FILTER (severity = 'HIGH') AS taint, arg_min(snippet, (line, issue)) AS first_snippet FROM f GROUP BY path""")
def k1_json_reports(spark, d):
    told = reports.json_reports(_findings(spark, d), "path")
    kind = "summary struct<files_scanned:int,total_findings:int,severity_breakdown:map<string,int>,stage_breakdown:map<string,int>>, findings array<struct<snippet:string,line:int>>"
    rows = told.select("path", F.from_json("document", kind).alias("j"))
    some = lambda c, k: F.coalesce(F.element_at(c, k), F.lit(0))
    s = F.col("j.summary")
    return rows.select(
        "path", s["files_scanned"].alias("files"), s["total_findings"].alias("n"), some(s["severity_breakdown"], "HIGH").alias("high"), some(s["severity_breakdown"], "LOW").alias("low"),
        some(s["stage_breakdown"], "Taint").alias("taint"), F.get("j.findings", F.lit(0))["snippet"].alias("first_snippet"),
    )


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a package of one of four ecosystems, told by two files that write its name differently."""
    rows = read(spark, d, "part").select(
        F.expr("if(p_partkey % 4 = 3, 'G.x:', '') || 'Pkg ' || p_partkey").alias("name"), F.expr("if(p_partkey % 5 = 0, null, cast(p_size as string))").alias("version"),
        F.expr("element_at(array('PyPI', 'npm', 'Go', 'Maven'), cast(p_partkey % 4 + 1 as int))").alias("ecosystem"), F.lit("a\\one.txt").alias("source_file"),
    )
    return rows.union(rows.select(F.upper("name"), "version", "ecosystem", F.lit("b/two.txt")))


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 4 = 3 THEN 'G.x:' ELSE '' END || 'Pkg ' || p_partkey AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_size::VARCHAR END AS version FROM part)
    SELECT name, version, ['PyPI', 'npm', 'Go', 'Maven'][p_partkey % 4 + 1] AS ecosystem,
    'pkg:' || ['pypi', 'npm', 'golang', 'maven'][p_partkey % 4 + 1] || '/' || CASE WHEN p_partkey % 4 = 3 THEN 'g.x/' ELSE '' END || 'pkg-' || p_partkey || '@' || coalesce(version, '') AS purl,
    lower(['PyPI', 'npm', 'Go', 'Maven'][p_partkey % 4 + 1]) || '-' || lower(name) || '-' || coalesce(version, 'unknown') AS ref, CASE WHEN p_partkey % 3 = 0 THEN 'GPL-3' END AS licence, 'a/one.txt' AS location FROM p""")
def k4_bill_of_materials(spark, d):
    licences = read(spark, d, "part").filter("p_partkey % 3 = 0").select(F.expr("if(p_partkey % 4 = 3, 'G.x:', '') || 'Pkg ' || p_partkey").alias("name"), F.lit("GPL-3").alias("licence"))
    told = reports.bill_of_materials(_dependencies(spark, d), licences)
    kind = "purl string, `bom-ref` string, licenses array<struct<license:struct<name:string>>>, evidence struct<occurrences:array<struct<location:string>>>"
    j = F.from_json("value", kind)
    return told.select(
        "name", "version", "ecosystem", j["purl"].alias("purl"), j["bom-ref"].alias("ref"), F.get(j["licenses"], F.lit(0))["license"]["name"].alias("licence"),
        F.get(j["evidence"]["occurrences"], F.lit(0))["location"].alias("location"),
    )


@query("""SELECT p_partkey, 'vuln-CVE-' || p_partkey || '-n' AS ref, CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity, p_size / 10.0::DOUBLE AS score,
    'npm-n-' || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE 'unknown' END AS affects, CASE WHEN p_partkey % 5 = 0 THEN 'Upgrade to n 2 or later.' END AS advice FROM part""")
def x10_bill_of_vulnerabilities(spark, d):
    rows = read(spark, d, "part").select(
        F.lit("n").alias("name"), F.expr("if(p_partkey % 2 = 0, '1', null)").alias("version"), F.lit("npm").alias("ecosystem"), F.expr("'CVE-' || p_partkey").alias("cve"), F.lit("s").alias("summary"),
        F.expr("element_at(array('Critical', 'LOW', 'x'), cast(p_partkey % 3 + 1 as int))").alias("severity"), (F.col("p_size") / 10.0).alias("cvss"), F.expr("if(p_partkey % 5 = 0, '2', null)").alias("fixed"),
    )
    kind = "`bom-ref` string, ratings array<struct<score:double,severity:string>>, affects array<struct<ref:string>>, recommendation string"
    j = F.from_json("value", kind)
    rating = F.get(j["ratings"], F.lit(0))
    return reports.bill_of_vulnerabilities(rows).select(
        F.substring("cve", 5, 20).cast("int").alias("p_partkey"), j["bom-ref"].alias("ref"), rating["severity"].alias("severity"), rating["score"].alias("score"),
        F.get(j["affects"], F.lit(0))["ref"].alias("affects"), j["recommendation"].alias("advice"),
    )


# import graphs: part k imports its half, its third by path, itself, and what no file stands for

_SQL_ENDINGS = "['.py', '.c', '.java', '.js', '.go', '.rs']"
_ENDINGS = "array('.py', '.c', '.java', '.js', '.go', '.rs')"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """path, content: file k of six languages; names and folders from k."""
    path = lambda k: f"concat('proj/d', ({k}) % 7, '/M', {k}, 'x', element_at({_ENDINGS}, cast(({k}) % 6 + 1 as int)))"
    half, near = "(p_partkey div 2 + 1)", "(p_partkey div 3 + 1)"
    text = f"""CASE p_partkey % 6
      WHEN 0 THEN concat('import m', {half}, 'x\\nfrom d', ({near}) % 7, '.m', {near}, 'x import y\\nimport gone.away')
      WHEN 1 THEN concat('#include "d', ({half}) % 7, '/m', {half}, 'x', element_at({_ENDINGS}, cast(({half}) % 6 + 1 as int)), '"\\n# include <M', {near}, 'x', element_at({_ENDINGS}, cast(({near}) % 6 + 1 as int)), '>')
      WHEN 2 THEN concat('import static m', {half}, 'x;\\nimport d', ({near}) % 7, '.m', {near}, 'x;')
      WHEN 3 THEN concat('import a from "./m', {half}, 'x"\\nconst b = require(''d', ({near}) % 7, '/m', {near}, 'x'')')
      WHEN 4 THEN concat('import "d', ({half}) % 7, '/m', {half}, 'x"\\nimport "m', {near}, 'x"')
      ELSE concat('use m', {half}, 'x\\nmod m', {near}, 'x\\nmod m', p_partkey, 'x') END"""
    return spread(spark, d, "part", "p_partkey").select(F.expr(path("p_partkey")).alias("path"), F.expr(text).alias("content"))


_SQL_ARCS = f"""path AS (SELECT p_partkey AS k, 'proj/d' || p_partkey % 7 || '/M' || p_partkey || 'x' || {_SQL_ENDINGS}[p_partkey % 6 + 1] AS path FROM part),
    a AS (SELECT p_partkey AS k, p_partkey // 2 + 1 AS t FROM part UNION SELECT p_partkey, p_partkey // 3 + 1 FROM part),
    arcs AS (SELECT DISTINCT s.path AS src, d.path AS dst, s.k AS a, d.k AS b FROM a JOIN path s ON s.k = a.k JOIN path d ON d.k = a.t WHERE s.k <> d.k)"""


@query(f"WITH {_SQL_ARCS} SELECT src, dst FROM arcs")
def g2_j22_import_edges(spark, d):
    return imports.edges(_sources(spark, d))


@query(f"""WITH RECURSIVE {_SQL_ARCS}, seed AS (SELECT 5 AS k), cone AS (SELECT k FROM seed UNION SELECT a.a FROM cone c JOIN arcs a ON a.b = c.k)
    SELECT path, CASE WHEN k IN (SELECT k FROM seed) THEN 'changed' ELSE 'affected' END AS why FROM path JOIN cone USING (k)""")
def g1_scan_set(spark, d):
    """The files that a change of one reaches over imports."""
    files = _sources(spark, d)
    changed = files.filter(F.col("path").rlike("/M5x[.]")).select("path")
    cone = graphs.cone(imports.reversed_edges(imports.edges(files)), changed.select(F.col("path").alias("node")))
    return imports.scan_set(files, changed, cone)


_SQL_NAMES = """SELECT p_partkey AS k, unnest(CASE p_partkey % 6 WHEN 0 THEN ['m' || h || 'x', 'd' || q % 7 || '/m' || q || 'x', 'gone/away']
    WHEN 1 THEN ['d' || h % 7 || '/m' || h || 'x' || {e}[h % 6 + 1], 'M' || q || 'x' || {e}[q % 6 + 1]] WHEN 2 THEN ['m' || h || 'x', 'd' || q % 7 || '/m' || q || 'x']
    WHEN 3 THEN ['./m' || h || 'x', 'd' || q % 7 || '/m' || q || 'x'] WHEN 4 THEN ['d' || h % 7 || '/m' || h || 'x', 'm' || q || 'x'] ELSE ['m' || h || 'x', 'm' || q || 'x', 'm' || p_partkey || 'x'] END) AS name
    FROM (SELECT p_partkey, p_partkey // 2 + 1 AS h, p_partkey // 3 + 1 AS q FROM part)""".replace("{e}", _SQL_ENDINGS)


@query(f"WITH n AS ({_SQL_NAMES}) SELECT DISTINCT 'proj/d' || k % 7 || '/M' || k || 'x' || {_SQL_ENDINGS}[k % 6 + 1] AS path, name FROM n")
def f12_imported_names(spark, d):
    return imports.imported(_sources(spark, d))


# stores of scan results


@query("""SELECT doc_id AS path, n_chars FROM documents WHERE NOT (n_chars < 800 AND doc_id NOT IN (SELECT doc_id FROM labels))""")
def k12_purged(spark, d):
    """Old entries (few characters stand for an early time) go where no file (label) is left."""
    entries = read(spark, d, "documents").select(F.col("doc_id").alias("path"), "n_chars")
    files = read(spark, d, "labels").select(F.col("doc_id").alias("path"))
    return relations.purged(entries, files, F.lit(800), "n_chars")


@query("SELECT url AS path FROM pages WHERE NOT starts_with(url, 'https://www.')")
def k11_without_prefix(spark, d):
    return relations.without_prefix(read(spark, d, "pages").select(F.col("url").alias("path")), "https://www.")


@query("""SELECT l_orderkey, CASE WHEN count(*) + sum(l_linenumber) > 0 THEN round(sum(l_linenumber) * 100.0 / (count(*) + sum(l_linenumber)), 1) ELSE 0 END::DOUBLE AS savings FROM lineitem GROUP BY 1""")
def a14_savings(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("a"), F.sum("l_linenumber").alias("b"))
    return rows.select("l_orderkey", relations.savings(F.col("a"), F.col("b")).cast("double").alias("savings"))
