"""Queries of the operators on the given tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import intervals, scalars
from lumenfold.operators import findings as f
from lumenfold.operators import flow, graphs, history, matching, relations, reports, supply
from lumenfold.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from lumenfold.plans.registry import read as _read
from lumenfold.plans.registry import spread as _spread
from lumenfold.plans.registry import values as _values
from lumenfold.sources import diffs, manifests
from lumenfold.sources import text as t
from lumenfold.streaming import ingest

FLAGSHIP = "w1_first_wins"

# rule_ord, stage_ord, stage, issue, severity, weakness, pattern (no look-around: RE2 has none), what every match holds
RULES = [
    (1, 1, "secrets", "cloud-key", "CRITICAL", "CWE-798", "AKIA[0-9A-Z]{16}", "AKIA"),
    (2, 1, "secrets", "password-literal", "HIGH", "CWE-259", "password=[0-9a-f]+", "password="),
    (3, 1, "secrets", "token-literal", "HIGH", "CWE-798", 'token = "[0-9a-f]+"', 'token = "'),
    (4, 2, "privacy", "email-address", "LOW", "CWE-359", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", "@"),
    (5, 2, "privacy", "ip-address", "INFO", "CWE-200", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "."),
    (6, 2, "privacy", "card-number", "HIGH", "", "[0-9]{16}", ""),
    (7, 3, "licence", "licence-line", "MEDIUM", "", "[Ll]icen[sc]e", "icen"),
]
#: A later stage that finds some of the same again, at other severities.
AGAIN = [
    (8, 4, "audit", "email-address", "HIGH", "CWE-359", "@mail[0-9]", "@mail"),
    (9, 4, "audit", "licence-line", "LOW", "", "MIT", "MIT"),
]
VULNERABILITIES = [("cloud-key", 9.1, "rotate the key"), ("password-literal", 7.5, "use a vault"), ("email-address", 3.1, "mask it")]
BY_CWE = {"CWE-798": "A07", "CWE-259": "A07", "CWE-200": "A01"}
BY_WORD = [("card", "A02"), ("address", "A01"), ("number", "A04")]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return t.lines(_read(spark, d, "documents"), "doc_id", "text")


def _found(spark: SparkSession, d: str) -> DataFrame:
    return f.match_rules(_lines(spark, d), RULES)


_SQL_LINES = r"""
  docs AS (SELECT doc_id AS path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
  lines AS (SELECT path, generate_subscripts(ls, 1) AS line, unnest(ls) AS text FROM docs)"""
_SQL_FOUND = rf"""WITH {_SQL_LINES},
  rules(rule_ord, stage_ord, stage, issue, severity, cwe, pattern, gate) AS (VALUES {_values(RULES)}),
  found AS (SELECT path, line, rule_ord, stage_ord, stage, issue, severity, cwe, regexp_replace(text, '^\s+|\s+$', '', 'g') AS snippet,
    list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], severity) - 1 AS sev_rank
    FROM lines, rules WHERE regexp_matches(text, pattern))"""

#: Scans: each user's events of a day, as counts by kind.
_SQL_SCANS = """WITH scans AS (SELECT user_id AS project, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS scan_id, min(ts) AS ts,
  count(*) AS total, count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'purchase') AS high
  FROM events GROUP BY 1, 2)"""


def _scans(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyyMMdd").cast("long").alias("scan_id")
    return _read(spark, d, "events").groupBy(F.col("user_id").alias("project"), day).agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("critical"), F.count_if(F.col("event_type") == "purchase").alias("high"),
    )


@query(f"WITH {_SQL_LINES} SELECT path, count(*) AS n_lines, max(length(text)) AS longest FROM lines GROUP BY path")
def s11_lines(spark, d):
    return _lines(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("text")).alias("longest"))


@query(f"{_SQL_FOUND} SELECT path, line, issue, severity, cwe, stage, snippet FROM found")
def j9_match_rules(spark, d):
    return _found(spark, d).select("path", "line", "issue", "severity", "cwe", "stage", "snippet")


@query(f"""{_SQL_FOUND.replace(_values(RULES), _values(RULES + AGAIN))} SELECT path, line, issue, stage, severity FROM found
    QUALIFY row_number() OVER (PARTITION BY path, line, issue ORDER BY stage_ord, rule_ord) = 1""")
def w1_first_wins(spark, d):
    """One finding for each file, line and issue: the first stage's. All hits of a line are in one row, so no shuffle."""
    return f.match_rules(_lines(spark, d), RULES + AGAIN, once=["issue"]).select("path", "line", "issue", "stage", "severity")


@query(f"""{_SQL_FOUND}, dim(issue, cvss, fix) AS (VALUES {_values(VULNERABILITIES)})
    SELECT path, line, issue, coalesce(cvss, 0.0)::DOUBLE AS cvss, coalesce(fix, 'review') AS fix,
    CASE WHEN coalesce(cvss, 0) >= 9 THEN 'CRITICAL' WHEN coalesce(cvss, 0) >= 7 THEN 'HIGH' WHEN coalesce(cvss, 0) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS band
    FROM found LEFT JOIN dim USING (issue)""")
def j1_p19_enrich(spark, d):
    dim = spark.createDataFrame(VULNERABILITIES, "issue string, cvss double, fix string")
    out = f.with_dimension(_found(spark, d), F.broadcast(dim), "issue", {"cvss": 0.0, "fix": "review"})
    return out.select("path", "line", "issue", "cvss", "fix", scalars.band(F.col("cvss")).alias("band"))


_SQL_CATEGORY = f"""{_SQL_FOUND}, told AS (SELECT *, CASE {' '.join(f"WHEN cwe = '{k}' THEN '{v}'" for k, v in BY_CWE.items())}
    {' '.join(f"WHEN contains(issue, '{k}') THEN '{v}'" for k, v in BY_WORD)} ELSE '' END AS category FROM found)"""


@query(f"{_SQL_CATEGORY} SELECT path, line, issue, category FROM told")
def j2_j3_category(spark, d):
    return f.category(_found(spark, d), BY_CWE, BY_WORD).select("path", "line", "issue", "category")


@query(f"""{_SQL_CATEGORY} SELECT category, count(*) AS n, count(DISTINCT path) AS files,
    count(*) FILTER (severity = 'HIGH') AS high FROM told GROUP BY category""")
def a7_coverage(spark, d):
    told = f.category(_found(spark, d), BY_CWE, BY_WORD)
    return told.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"), F.count_if(F.col("severity") == "HIGH").alias("high")
    )


@query(f"{_SQL_CATEGORY} SELECT category, path, line, issue FROM told QUALIFY row_number() OVER (PARTITION BY category ORDER BY path, line, rule_ord) <= 3")
def w7_samples(spark, d):
    told = f.category(_found(spark, d), BY_CWE, BY_WORD)
    return f.firsts(told, "category", ["path", "line", "rule_ord"], 3).select("category", "path", "line", "issue")


@query(f"{_SQL_FOUND} SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM found GROUP BY severity")
def a1_severities(spark, d):
    return f.shares(_found(spark, d), "severity")


@query(f"{_SQL_FOUND} SELECT stage, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM found GROUP BY stage")
def a1_stages(spark, d):
    return f.shares(_found(spark, d), "stage")


@query(f"""{_SQL_FOUND} SELECT path, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'))},
    count(*) AS total FROM found GROUP BY path""")
def a3_pivot(spark, d):
    return f.pivoted(_found(spark, d))


@query(f"{_SQL_FOUND} SELECT stage, issue, count(*) AS n FROM found GROUP BY ROLLUP (stage, issue)")
def a4_totals(spark, d):
    return _found(spark, d).rollup("stage", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_SQL_FOUND} SELECT path, coalesce(worst, 'SECURE') AS worst FROM docs LEFT JOIN
    (SELECT path, max_by(severity, sev_rank) AS worst FROM found WHERE sev_rank >= 1 GROUP BY path) USING (path)""")
def a5_worst(spark, d):
    return f.worst(_read(spark, d, "documents").select(F.col("doc_id").alias("path")), _found(spark, d))


@query(f"{_SQL_FOUND}, firsts AS (SELECT issue, min(path) AS first_path FROM found GROUP BY issue) SELECT * FROM firsts ORDER BY first_path, issue LIMIT 5")
def w6_first_issues(spark, d):
    """The limit is the feature: a short report of the issues seen first."""
    return _found(spark, d).groupBy("issue").agg(F.min("path").alias("first_path")).orderBy("first_path", "issue").limit(5)


@query(f"""{_SQL_FOUND}, pred AS (SELECT DISTINCT path FROM found WHERE sev_rank >= 3),
    told AS (SELECT d.lang AS suite, l.toxic AS truth, (p.path IS NOT NULL)::INT AS pred FROM labels l JOIN documents d USING (doc_id) LEFT JOIN pred p ON p.path = l.doc_id),
    c AS (SELECT suite, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp,
      count(*) FILTER (truth = 1 AND pred = 0) AS fn FROM told GROUP BY ROLLUP (suite))
    SELECT suite, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
      round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1 FROM c""")
def a13_accuracy(spark, d):
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels")
    pred = _found(spark, d).filter("sev_rank >= 3").select(F.col("path").alias("doc_id")).distinct().withColumn("hit", F.lit(1))
    told = labels.join(docs.select("doc_id", F.col("lang").alias("suite")), "doc_id").join(pred, "doc_id", "left")
    return f.accuracy(told.select("suite", F.col("toxic").alias("truth"), F.coalesce("hit", F.lit(0)).alias("pred")), "suite")


@query(f"""{_SQL_SCANS}, b AS (SELECT *, lag(total) OVER (PARTITION BY project ORDER BY ts, scan_id) AS before FROM scans)
    SELECT project, scan_id, total, total - before AS change, CASE WHEN before IS NULL THEN 'first' WHEN total < before THEN 'improving'
    WHEN total > before THEN 'worsening' ELSE 'stable' END AS trend FROM b""")
def w9_trend(spark, d):
    return history.trend(_scans(spark, d))


@query(f"""{_SQL_SCANS}, r AS (SELECT *, concat_ws('; ', CASE WHEN critical > 1 THEN 'critical ' || critical END,
    CASE WHEN high > 2 THEN 'high ' || high END) AS reasons FROM scans)
    SELECT project, scan_id, reasons, reasons = '' AS passed FROM r""")
def w9_gate(spark, d):
    return history.gate(_scans(spark, d), 1, 2)


@query(f"{_SQL_SCANS} SELECT project, scan_id, total FROM scans QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) <= 3")
def k13_latest(spark, d):
    return history.latest(_scans(spark, d), 3).select("project", "scan_id", "total")


_EDGES = "SELECT DISTINCT c_custkey // 7 AS src, (c_custkey * 5 + c_nationkey) % ((SELECT count(*) FROM customer) // 7 + 1) AS dst FROM customer"


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    """Edges over as many nodes as a seventh of the customers."""
    rows = _read(spark, d, "customer")
    return rows.selectExpr("c_custkey div 7 AS src", f"(c_custkey * 5 + c_nationkey) % {rows.count() // 7 + 1} AS dst")


@query(f"""WITH RECURSIVE edges AS ({_EDGES}), cone AS (SELECT 7::BIGINT AS node UNION SELECT e.dst FROM cone c JOIN edges e ON e.src = c.node)
    SELECT node FROM cone""")
def g1_cone(spark, d):
    return graphs.cone(_arcs(spark, d).distinct(), spark.createDataFrame([(7,)], "node long")).select("node")


@query("""WITH RECURSIVE edges AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_size <= 30
      UNION SELECT (p_partkey * 7 + 3) % (SELECT count(*) FROM part), p_partkey FROM part WHERE p_size > 45),
    cone AS (SELECT 1::BIGINT AS node UNION SELECT e.dst FROM cone c JOIN edges e ON e.src = c.node)
    SELECT node FROM cone""")
def g1_cone_parts(spark, d):
    """The reverse cone of node 1 over edges part -> part, whose nodes grow with the table."""
    parts = _read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("dst"), "p_size")
    total = parts.count()
    halves = parts.filter("p_size <= 30").selectExpr("dst div 2 AS src", "dst")
    others = parts.filter("p_size > 45").selectExpr(f"(dst * 7 + 3) % {total} AS src", "dst")
    return graphs.cone(halves.union(others).distinct(), spark.createDataFrame([(1,)], "node long")).select("node")


@query(f"SELECT src, count(DISTINCT dst) AS n_edges FROM ({_EDGES}) GROUP BY src")
def a15_edges(spark, d):
    edges = _arcs(spark, d)
    return relations.edge_counts(edges)


@query("""WITH a AS (SELECT user_id, min(ts) AS opened FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT e.user_id, opened, min(e.ts) AS used FROM events e JOIN a USING (user_id) WHERE e.event_type = 'click' AND e.ts > opened GROUP BY 1, 2""")
def j14_first_after(spark, d):
    kind = F.col("event_type")
    return relations.first_after(_read(spark, d, "events"), "user_id", "ts", kind == "purchase", kind == "click")


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)
    SELECT e.event_id, e.user_id FROM e WHERE e.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e g
    WHERE g.user_id = e.user_id AND g.event_type = 'signup' AND e.s BETWEEN g.s AND g.s + 43200)""")
def j12_unguarded(spark, d):
    """Errors that no signup of the same user in the twelve hours before covers."""
    events = _seconds(spark, d)
    guards, told = events.filter("event_type = 'signup'"), events.filter("event_type = 'error'").select("event_id", "user_id", "s")
    return relations.unguarded(told, guards.select("user_id", "s"), "user_id", "s", 43200).select("event_id", "user_id")


@query("""SELECT event_id, user_id, n FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n
    FROM events WHERE event_type = 'signup') WHERE n > 1""")
def j15_repeats(spark, d):
    told = _read(spark, d, "events").filter("event_type = 'signup'")
    return relations.repeated(told, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j23_remaining(spark, d):
    """Customers without a finished order."""
    changed = _read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.remaining(_read(spark, d, "customer").select("c_custkey"), changed, "c_custkey")


@query("""WITH t AS (SELECT doc_id FROM labels WHERE toxic = 1), p AS (SELECT doc_id FROM labels WHERE quality = 0)
    SELECT 'tp' AS kind, doc_id FROM (SELECT * FROM t INTERSECT SELECT * FROM p) UNION ALL
    SELECT 'fp', doc_id FROM (SELECT * FROM p EXCEPT SELECT * FROM t) UNION ALL SELECT 'fn', doc_id FROM (SELECT * FROM t EXCEPT SELECT * FROM p)""")
def u1_set_ops(spark, d):
    labels = _read(spark, d, "labels")
    return f.confusion(labels.filter("toxic = 1").select("doc_id"), labels.filter("quality = 0").select("doc_id"))


#: Lines of requirement files, and what each tells: name and version, both null where it holds no package.
_REQUIREMENTS = [
    ("pkg{k}=={k}.0", "pkg{k}", "{k}.0"),
    ("  spaced >= 1.{k} ; python_version > '3'", "spaced", "1.{k}"),
    ("a-b.c_d~={k}.1,<9", "a-b.c_d", "{k}.1"),
    ("low<2", "low", "2"),
    ("both>1.0,<{k}", "both", "1.0"),
    ("not!={k}#why", "not", "{k}"),
    ("plain", "plain", None),
    ("extra[all]=={k}", "extra", None),
    ("# comment=={k}", None, None),
    ("-r base{k}.txt", None, None),
    ("--index-url https://example.com/{k}", None, None),
    ("./local{k}", None, None),
    ("", None, None),
    ("\ttabbed==={k}", "tabbed", "{k}"),
]


@query(f"""WITH r(text, name, version) AS (VALUES {_values(_REQUIREMENTS)}) SELECT p_partkey AS source_file, replace(name, '{{k}}', p_partkey::VARCHAR) AS name,
    replace(version, '{{k}}', p_partkey::VARCHAR) AS version FROM part, r WHERE name IS NOT NULL""")
def s19_requirements(spark, d):
    lines = [F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string")) for t, _, _ in _REQUIREMENTS]
    rows = _read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.posexplode(F.array(*lines)).alias("line", "text"))
    return t.requirements(rows).select("source_file", "name", "version")


#: Severities as they are told, with a confidence, and what is meant (fixed by the rules of normalising).
_TOLD = [
    ("CRIT", None, "CRITICAL"), ("critical", "Low", "CRITICAL"), (" hi ", None, "HIGH"), ("Med", None, "MEDIUM"), ("informational", "High", "INFO"),
    ("INFORMATION", None, "INFO"), ("N/A", " high", "HIGH"), ("", "Low", "LOW"), (None, "hi", "HIGH"), ("worst", "sure", "MEDIUM"), (None, None, "MEDIUM"),
]


@query(f"""WITH t(told, conf, severity) AS (VALUES {_values(_TOLD)}) SELECT event_id, severity,
    CASE event_id % 5 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-' || event_id WHEN 2 THEN '' WHEN 3 THEN 'CWE-7' ELSE '' END AS cwe FROM events, t""")
def p1_p2_normalise(spark, d):
    cwe = F.expr("CASE event_id % 5 WHEN 0 THEN '89' WHEN 1 THEN 'cwe ' || event_id WHEN 2 THEN 'N/A' WHEN 3 THEN 'CWE-7 (or CWE-8)' END")
    rows = _read(spark, d, "events").select("event_id", cwe.alias("cwe"), F.explode(F.array(*[F.struct(F.lit(a).cast("string").alias("told"), F.lit(b).cast("string").alias("conf")) for a, b, _ in _TOLD])).alias("t"))
    return rows.select("event_id", scalars.severity(F.col("t.told"), F.col("t.conf")).alias("severity"), scalars.weakness(F.col("cwe")).alias("cwe"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_=+/-]{16,}')) AS token FROM documents),
    c AS (SELECT doc_id, token, length(token) AS n, count(*) AS k FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM w) GROUP BY doc_id, token, ch)
    SELECT doc_id, token, round(-sum((k / n) * log2(k / n)), 6) + 0.0 AS bits FROM c GROUP BY doc_id, token""")
def a18_entropy(spark, d):
    """The entropy of each long token of the whole texts, as secrets are told from words."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_=+/-]{16,}"), F.lit(0)))).alias("token")
    told = _read(spark, d, "documents").select("doc_id", found)
    return told.select("doc_id", "token", (F.round(scalars.entropy(F.col("token")), 6) + 0.0).alias("bits"))


_PREFIXES = [("pu", "buy"), ("p", "other"), ("cl", "look"), ("c", "other")]
_INSIDE = [("ro", "fault"), ("i", "small"), ("e", "wide")]
_ENDS = [("up", "join"), ("w", "look")]


def _cases(rules: list[tuple[str, str]], call: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {call}({column}, '{k}') THEN '{v}'" for k, v in rules) + " ELSE '' END"


@query(f"""SELECT event_id, {_cases(_PREFIXES, 'starts_with', 'event_type')} AS tool, {_cases(_INSIDE, 'contains', 'event_type')} AS rule,
    {_cases(_ENDS, 'ends_with', 'event_type')} AS sink FROM events""")
def j6_j7_j8_first_match(spark, d):
    kind = F.col("event_type")
    return _read(spark, d, "events").select(
        "event_id",
        matching.first_match(kind, _PREFIXES, "prefix").alias("tool"),
        matching.first_match(kind, _INSIDE, "contains").alias("rule"),
        matching.first_match(kind, _ENDS, "suffix").alias("sink"),
    )


_SQL_SECONDS = "WITH e AS (SELECT event_id, user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)"


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("s"))


@query(f"""{_SQL_SECONDS} SELECT v.event_id, max(g.event_id) AS scope, min(g.s) AS opened FROM e v JOIN (SELECT user_id, min(event_id) AS event_id, s FROM e
    WHERE event_type = 'signup' GROUP BY user_id, s) g ON g.user_id = v.user_id AND v.s BETWEEN g.s AND g.s + 21600
    WHERE v.event_type = 'view' GROUP BY v.event_id""")
def j13_enclosing(spark, d):
    """Range join in bins: the scopes of six hours that hold a view."""
    e = _seconds(spark, d)
    spans = e.filter("event_type = 'signup'").groupBy("user_id", F.col("s").alias("opens")).agg(F.min("event_id").alias("scope"))
    spans = spans.withColumn("closes", F.col("opens") + 21600)
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "s")
    held = matching.binned_within(views, spans, "user_id", "s", "opens", "closes", 21600)
    return held.groupBy("event_id").agg(F.max("scope").alias("scope"), F.min("opens").alias("opened"))


@query(f"""{_SQL_SECONDS}, flows AS (SELECT a.event_id AS source, b.event_id AS sink, a.user_id, a.s AS s0, b.s AS s1 FROM e a JOIN e b ON a.user_id = b.user_id
      AND b.s BETWEEN a.s AND a.s + 86400 WHERE a.event_type = 'signup' AND b.event_type = 'purchase')
    SELECT source, sink, min(c.s) AS cleaned FROM flows f JOIN e c ON c.user_id = f.user_id AND c.event_type = 'error' AND c.s BETWEEN s0 AND s1 GROUP BY 1, 2""")
def j11_sanitised_between(spark, d):
    e = _seconds(spark, d)
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("source"), F.col("s").alias("s0"))
    spans = spans.withColumn("last", F.col("s0") + 86400)
    sinks = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("sink"), F.col("s").alias("s1"))
    flows = matching.binned_within(sinks, spans, "user_id", "s1", "s0", "last", 86400).drop("last")
    guards = e.filter("event_type = 'error'").select("user_id", F.col("s").alias("cleaned"))
    held = matching.binned_within(guards, flows, "user_id", "cleaned", "s0", "s1", 86400)
    return held.groupBy("source", "sink").agg(F.min("cleaned").alias("cleaned"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS section,
    CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS depth,
    count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS near_errors
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w12_w13_w14_running_state(spark, d):
    """One sort serves all three windows: the open section, the running depth, errors in the six rows before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto, back = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-6, -1)
    step = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END")
    section = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(upto)
    near = F.count_if(F.col("event_type") == "error").over(back)
    return _read(spark, d, "events").select("event_id", section.alias("section"), F.sum(step).over(upto).alias("depth"), near.alias("near_errors"))


@query(f"""{_SQL_FOUND}, r AS (SELECT path, line, issue, round(CASE CASE WHEN issue = 'card-number' THEN 'SEVERE' ELSE severity END {' '.join(f"WHEN '{k}' THEN {v}" for k, v in reports.BASE.items())} ELSE 5.0 END
    * CASE WHEN line % 2 = 0 THEN 0.3 ELSE 1.0 END, 1)::DOUBLE AS risk, line % 2 = 0 AS sanitised FROM found)
    SELECT path, line, issue, risk FROM r WHERE NOT (sanitised AND risk < 2.0)""")
def f15_risk(spark, d):
    clean = F.col("line") % 2 == 0
    severity = F.when(F.col("issue") == "card-number", "SEVERE").otherwise(F.col("severity"))  # a word no list has
    told = _found(spark, d).withColumn("risk", reports.risk(severity, clean))
    return told.filter(~(clean & (F.col("risk") < 2.0))).select("path", "line", "issue", "risk")


@query(f"{_SQL_FOUND} SELECT path, line, issue FROM found WHERE sev_rank >= 2 AND issue NOT IN ('licence-line')")
def p4_p5_filters(spark, d):
    return f.at_least(_found(spark, d), 2, left_out=["licence-line"]).select("path", "line", "issue")


@query(f"{_SQL_FOUND} SELECT path, bool_or(sev_rank >= 3) AS fails FROM found GROUP BY path")
def p8_exit_code(spark, d):
    return f.fails(_found(spark, d), 3)


@query(f"{_SQL_FOUND} SELECT severity, stage, count(*) AS n FROM found GROUP BY GROUPING SETS ((severity), (stage))")
def a8_two_groupings(spark, d):
    told = _found(spark, d)
    return told.groupingSets([["severity"], ["stage"]], "severity", "stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SQL_FOUND} SELECT path FROM docs WHERE path NOT IN (SELECT path FROM found WHERE issue = 'email-address')")
def a17_missing(spark, d):
    return f.lacking(_read(spark, d, "documents").select(F.col("doc_id").alias("path")), _found(spark, d), "email-address")


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def a10_store_stats(spark, d):
    return relations.store_stats(_read(spark, d, "events"), "event_type", "ts")


@query("SELECT page_id, url FROM pages WHERE NOT (url GLOB '*example.com*' OR regexp_extract(url, '([^/]*)$', 1) GLOB '*7')")
def p6_paths(spark, d):
    return _read(spark, d, "pages").filter(~matching.excluded(F.col("url"), ["*example.com*", "*7"])).select("page_id", "url")


@query(r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name,
    lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\.[^.]+)$', 1)) AS ext FROM pages""")
def f3_path_parts(spark, d):
    parts = matching.path_parts(F.col("url"))
    return _read(spark, d, "pages").select("page_id", *(v.alias(k) for k, v in parts.items()))


@query(f"""{_SQL_FOUND} SELECT path, line, CASE {' '.join(f"WHEN contains(upper(snippet), '{x}') THEN '{x}'" for x in supply.RISKY)} ELSE '' END AS risk
    FROM found WHERE issue = 'licence-line'""")
def j26_licence_risk(spark, d):
    told = _found(spark, d).filter("issue = 'licence-line'")
    return told.select("path", "line", supply.licence_risk(F.col("snippet")).alias("risk"))


@query("""WITH r AS (SELECT left(sha256(text), 16) AS prefix, min(doc_id) AS origin FROM documents WHERE lang = 'en' GROUP BY 1)
    SELECT doc_id AS path, origin FROM documents JOIN r ON left(sha256(text), 16) = prefix""")
def j27_known_snippets(spark, d):
    docs = _read(spark, d, "documents")
    prefix = F.left(F.sha2("text", 256), F.lit(16)).alias("prefix")
    registry = docs.filter("lang = 'en'").groupBy(prefix).agg(F.min("doc_id").alias("origin"))
    return supply.known_snippets(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), registry).select("path", "origin")


_ENDED = ["base:7", "base:3.1", "base:12"]


@query(f"""WITH i AS (SELECT p_partkey, p_size % 9 || '.' || p_partkey % 4 AS tag FROM part)
    SELECT p_partkey, 'base' AS base, tag, 'base:' || tag IN {tuple(_ENDED)} OR 'base:' || split_part(tag, '.', 1) IN {tuple(_ENDED)} AS ended FROM i""")
def j28_base_images(spark, d):
    rows = _read(spark, d, "part").select("p_partkey", F.expr("'store/base:' || p_size % 9 || '.' || p_partkey % 4").alias("image"))
    parts = supply.base_image(F.col("image"))
    return rows.select("p_partkey", parts["base"].alias("base"), parts["tag"].alias("tag"), supply.end_of_life(F.col("image"), _ENDED).alias("ended"))


@query("""SELECT p_partkey, 'pkg:pypi/' || lower(p_name) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '@' || p_size END AS purl FROM part""")
def f17_addresses(spark, d):
    version = F.expr("if(p_size % 3 = 0, null, cast(p_size as string))")
    return _read(spark, d, "part").select("p_partkey", supply.package_address("pypi", F.col("p_name"), version).alias("purl"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j32_left_defaults(spark, d):
    n = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return relations.with_defaults(_read(spark, d, "customer").select("c_custkey"), n, "c_custkey", {"n_orders": 0})


@query("""SELECT doc_id, quality FROM labels WHERE toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT doc_id, quality + 10 FROM labels WHERE toxic = 1""")
def k9_upsert(spark, d):
    labels = _read(spark, d, "labels")
    new = labels.filter("toxic = 1").select("doc_id", (F.col("quality") + 10).alias("quality"))
    return reports.upsert(labels.filter("toxic = 0").select("doc_id", "quality"), new, ["doc_id"])


@query("""SELECT 'f' || event_id || CASE WHEN event_id % 3 = 0 THEN ' b.c' ELSE '.c' END AS path, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 40 END AS additions,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END AS deletions FROM events""")
def f22_numstat(spark, d):
    told = F.expr("if(event_id % 5 = 0, '-\t-', event_id % 40 || '\t' || user_id) || '\tf' || event_id || if(event_id % 3 = 0, ' b.c', '.c')")
    return diffs.numstat(_read(spark, d, "events").select(told.alias("text")))


@query(f"""{_SQL_FOUND}, u AS (SELECT path, line, issue, stage_ord FROM found UNION ALL SELECT path, line, 'cloud-key', 0 FROM found WHERE line % 2 = 0 AND rule_ord = 7)
    SELECT path, line, issue, min(stage_ord)::INT AS stage_ord FROM u GROUP BY ALL""")
def j24_anti_merge(spark, d):
    """Findings of the stronger source stay; the weaker one adds only what is new."""
    told = _found(spark, d)
    twice = F.when(F.expr("rule_ord = 7 and line % 2 = 0"), F.array(F.struct(F.lit("cloud-key").alias("issue"), F.lit(0).alias("stage_ord")))).otherwise(F.array().cast("array<struct<issue:string,stage_ord:int>>"))
    both = F.concat(F.array(F.struct("issue", "stage_ord")), twice)  # one scan serves both sources
    rows = told.select("path", "line", F.explode(both).alias("f")).select("path", "line", "f.*")
    return f.first_wins(rows, ["path", "line", "issue"], ["stage_ord"])


@query(f"""{_SQL_FOUND} SELECT path, line, issue, json_object('ruleId', issue, 'level', CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'warning' END,
      'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path::VARCHAR), 'region', json_object('startLine', greatest(line, 1), 'snippet', json_object('text', left(snippet, 300)))))))::VARCHAR AS value FROM found""")
def k3_sarif(spark, d):
    """JSON text; SQL writes it alike, without spaces and with fields in the same order."""
    return reports.sarif_results(_found(spark, d))


def _made_lines(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """One file for each row, its lines by SQL expressions."""
    told = rows.select(F.col(key).alias("path"), F.posexplode(F.array(*map(F.expr, texts))).alias("at", "text"))
    return told.select("path", (F.col("at") + 1).alias("line"), "text")


def _manifest(spark: SparkSession, d: str, text: str) -> DataFrame:
    """A manifest for each part: {k} is its key, {v} its size."""
    made = F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{v}"), F.col("p_size").cast("string"))
    return _spread(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("path"), made.alias("content"))


def _told(*found: tuple) -> str:
    """SQL of what each part's manifest tells."""
    return f"""WITH r(name, version) AS (VALUES {_values(list(found))}) SELECT p_partkey AS source_file,
      replace(replace(name, '{{k}}', p_partkey::VARCHAR), '{{v}}', p_size::VARCHAR) AS name, replace(replace(version, '{{k}}', p_partkey::VARCHAR), '{{v}}', p_size::VARCHAR) AS version FROM part, r"""


@query(_told(("one", "{v}"), ("two", "2.{k}"), ("three", None), ("opt", "1"), ("build", "40"), ("p{k}", "{v}"), ("tab-le", "3.{v}"), ("any", "*"), ("q.t", "5"), ("dev", None)))
def s20_pyproject(spark, d):
    return manifests.pyproject(_manifest(spark, d, """# top
[build-system]
requires = ["build>=40"]
[project]
name = "me"  # own
dependencies = [
  "one=={v}",  # first
  "two[x,y] >=2.{k},<9 ; python_version > '3'",
  'three',
]
[project.optional-dependencies]
more = ["opt~=1"]
[tool.poetry.dependencies]
python = "^3.9"
p{k} = "^{v}"
tab-le = { git = "x", version = ">=3.{v}" }
any = "*"
"q.t" = '5'
[ tool . poetry . group . "test" . dependencies ]
dev = { path = "../dev" }
[tool.other]
line = "1"
"""))


@query(_told(("p{k}", "{v}"), ("dev-{v}", None), ("til-{v}", "1.{v}"), ("peer", "{v}.x"), ("opt", "2")))
def s21_package_json(spark, d):
    files = _manifest(spark, d, """{"name": "n", "dependencies": {"p{k}": "^{v}"}, "devDependencies": {"dev-{v}": {"version": "1"}, "til-{v}": "~1.{v}"},
      "peerDependencies": {"peer": ">={v}.x"}, "optionalDependencies": {"opt": "2"}}""")
    return manifests.package_json(files.union(files.select("path", F.lit('{"dependencies": {').alias("content"))))


@query(_told(("p{k}", "{v}"), ("full", "1.{v}"), ("local", None), ("b-{v}", "0.{v}"), ("win", "7"), ("own", "{k}"), ("dot", "3")))
def s22_cargo(spark, d):
    return manifests.cargo(_manifest(spark, d, """early = "1"
[package]
version = "0.1"
[ dependencies ]  # these
p{k} = "={v}"
full = { version = "1.{v}", features = ["a", "b"] }
local = { path = "x" }
dot.version = "3"
[features]
std = ["x"]
[build-dependencies]
"b-{v}"="0.{v}"
[target.'cfg(windows)'.dependencies]
win = "~7"
[dependencies.own]
version = "{k}"
optional = true
"""))


@query(_told(("ex.org/p{k}", "v1.{v}"), ("one/a-b", "v0.{v}"), ("two", "v2.0.0-rc1+x"), ("last", "v9")))
def s23_go_mod(spark, d):
    return manifests.go_mod(_manifest(spark, d, """module m
require one/a-b v0.{v}
out v9
require (
	ex.org/p{k} v1.{v}
 two v2.0.0-rc1+x // indirect
 // gone v1
)
replace ( two => ../two
)
exclude no v1
require last v9
after v3
"""))


@query(_told(("g{v}:p{k}", "{v}"), ("h:free", None), ("m:managed", "2"), ("f:prof", "3")))
def s24_pom(spark, d):
    return manifests.pom(_manifest(spark, d, """<?xml version="1.0"?><project><version>9</version><dependencies><dependency>
<!-- one --><groupId>g{v}</groupId><scope>test</scope><artifactId> p{k} </artifactId>
<version>{v}</version></dependency><dependency><groupId>h</groupId><artifactId>free</artifactId></dependency><dependency><groupId>half</groupId></dependency></dependencies>
<dependencyManagement><dependencies><dependency><artifactId>managed</artifactId><groupId>m</groupId><version>2</version></dependency></dependencies></dependencyManagement>
<profiles><profile><dependencies><dependency><groupId>f</groupId><artifactId>prof</artifactId><version>3</version></dependency></dependencies></profile></profiles></project>"""))


@query(_told(("com.g:p{k}", "{v}.0-jre"), ("a:b", None), ("n:m", "{v}"), ("x:y", "1"), ("v:ar", None), ("k:apt", "2")))
def s25_gradle(spark, d):
    return manifests.gradle(_manifest(spark, d, """dependencies {
  implementation "com.g:p{k}:{v}.0-jre"
  api 'a:b'
  // compile "no:no:1"
  testImplementation group: 'n', name: 'm', version: '{v}'
  runtimeOnly(
    "x:y:1")
  compileOnly "v:ar:$version"
  kapt("k:apt:2@aar")
  other "q:r:1"
}"""))


@query("""SELECT 'src/f' || o_orderkey || '.c' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE 'M' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 'old' || o_orderkey END AS old_path, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END AS additions, o_orderkey % 11 AS deletions FROM orders""")
def j32_s13_changed_paths(spark, d):
    """Names and counts of a comparison, joined by path."""
    rows = _read(spark, d, "orders")
    name = "'src/f' || o_orderkey || '.c'"
    names = rows.select(F.expr(f"if(o_orderkey % 3 = 0, 'R090\told' || o_orderkey || '\t', 'M\t') || {name}").alias("text"))
    counts = rows.select(F.expr(f"if(o_orderkey % 5 = 0, '-', cast(o_custkey AS string)) || '\t' || o_orderkey % 11 || '\t' || {name}").alias("text"))
    out = diffs.name_status(names).join(diffs.numstat(counts), "path", "left")
    return out.select("path", "status", "old_path", F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


@query("""SELECT o_orderkey AS diff, 'a.c' AS path, o_custkey + 1 AS line FROM orders UNION ALL SELECT o_orderkey, 'a.c', o_custkey + 2 FROM orders
    UNION ALL SELECT o_orderkey, 'a.c', 900000 FROM orders UNION ALL SELECT o_orderkey, 'b.c', 5 FROM orders""")
def f23_changed_lines(spark, d):
    texts = ["'diff --git a/a.c b/a.c'", "'--- a/a.c'", "'+++ b/a.c'", "'@@ -1,3 +' || o_custkey || ',4 @@'", "' same'", "'-gone'", "'+one'", "'+two'", "' same'",
             "'@@ -9 +900000 @@'", "'+far'", "'--- a/b.c'", "'+++ b/b.c'", "'@@ -4,0 +5 @@'", "'+new'", "'-old'"]
    rows = _made_lines(_spread(spark, d, "orders", "o_orderkey"), "o_orderkey", *texts)
    return diffs.changed_lines(rows.withColumnsRenamed({"path": "diff", "line": "at"}))


_SQL_FLOW = """edges AS (SELECT DISTINCT c_custkey // 12 AS func, c_custkey % 12 AS src, (c_custkey % 12 * 5 + c_nationkey) % 12 AS dst FROM customer
    UNION SELECT c_custkey // 12, c_custkey % 12, (c_custkey + 1) % 12 FROM customer WHERE c_nationkey % 2 = 0)"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "customer")
    jumps = rows.selectExpr("c_custkey div 12 AS func", "c_custkey % 12 AS src", "(c_custkey % 12 * 5 + c_nationkey) % 12 AS dst")
    nexts = rows.filter("c_nationkey % 2 = 0").selectExpr("c_custkey div 12 AS func", "c_custkey % 12 AS src", "(c_custkey + 1) % 12 AS dst")
    return jumps.union(nexts).distinct()


@query(f"""WITH RECURSIVE {_SQL_FLOW}, c AS (SELECT func, src, dst FROM edges UNION SELECT c.func, c.src, e.dst FROM c JOIN edges e ON e.func = c.func AND e.src = c.dst)
    SELECT func, src, dst FROM c""")
def g10_g14_closure(spark, d):
    return flow.closure(_flow(spark, d))


@query(f"""WITH RECURSIVE {_SQL_FLOW}, r AS (SELECT DISTINCT func, 1::BIGINT AS node FROM edges UNION SELECT r.func, e.dst FROM r JOIN edges e ON e.func = r.func AND e.src = r.node),
    a AS (SELECT func, node AS dom, 1::BIGINT AS node FROM r WHERE node <> 1 UNION SELECT a.func, a.dom, e.dst FROM a JOIN edges e ON e.func = a.func AND e.src = a.node WHERE e.dst <> a.dom)
    SELECT r.func, r.node, x.node AS dom FROM r JOIN r x ON x.func = r.func WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.func = r.func AND a.dom = x.node AND a.node = r.node)""")
def g5_dominators(spark, d):
    edges = _flow(spark, d)
    return flow.dominators(edges, edges.select("func", F.lit(1).cast("long").alias("node")).distinct())


_SQL_DEFS = "defs AS (SELECT DISTINCT c_custkey // 12 AS func, c_custkey % 12 AS node, c_nationkey % 3 AS var FROM customer)"


@query(f"""WITH RECURSIVE {_SQL_FLOW}, {_SQL_DEFS}, r AS (SELECT d.func, d.var, d.node AS def, e.dst AS node FROM defs d JOIN edges e ON e.func = d.func AND e.src = d.node
    UNION SELECT r.func, r.var, r.def, e.dst FROM r JOIN edges e ON e.func = r.func AND e.src = r.node
      LEFT JOIN defs k ON k.func = r.func AND k.node = r.node AND k.var = r.var WHERE k.var IS NULL) SELECT func, var, def, node FROM r""")
def g6_reaching(spark, d):
    defs = _read(spark, d, "customer").selectExpr("c_custkey div 12 AS func", "c_custkey % 12 AS node", "c_nationkey % 3 AS var")
    return flow.reaching(_flow(spark, d), defs)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_quantity::BIGINT AS b, l_partkey % 5 AS c, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 50 END AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, least(a, c)::BIGINT AS joined_lo, CASE WHEN e IS NOT NULL THEN greatest(b, e) END::BIGINT AS joined_hi, greatest(a, c)::BIGINT AS met_lo,
    least(b, e)::BIGINT AS met_hi, (b + e)::BIGINT AS sum_hi, e IS NULL OR e > 20 AS exceeds FROM i""")
def f19_intervals(spark, d):
    a = intervals.interval(F.col("l_linenumber"), F.col("l_quantity"))
    b = intervals.interval(F.expr("l_partkey % 5"), F.expr("if(l_suppkey % 7 > 0, l_suppkey % 50, null)"))
    both, inner = intervals.joined(a, b), intervals.met(a, b)
    return _read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", both["lo"].alias("joined_lo"), both["hi"].alias("joined_hi"), inner["lo"].alias("met_lo"), inner["hi"].alias("met_hi"),
        intervals.added(a, b)["hi"].alias("sum_hi"), intervals.can_exceed(b, F.lit(20)).alias("exceeds"),
    )


@query("""SELECT p_partkey, greatest(p_size % 10 + 0.5, p_size % 7)::DOUBLE AS cvss, CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR ELSE 'later' END AS fixed FROM part""")
def j25_f16_advisories(spark, d):
    """Highest score out of vectors' texts, and the first version that fixes the package."""
    scores = F.expr("array('CVSS:3.1/AV:N/' || p_size % 10 || '.5', 'none', p_size % 7 || '.0')")
    affected = F.expr("""array(struct('other' AS name, array('0') AS fixed), struct(upper(p_name) AS name, array(if(p_size % 2 = 1, cast(p_size AS string), null), 'later') AS fixed))""")
    return _read(spark, d, "part").select("p_partkey", supply.cvss(scores).alias("cvss"), supply.fixed_version(affected, F.col("p_name")).alias("fixed"))


@query("""SELECT event_id, CASE greatest(least(CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 1 ELSE 2 END + CASE WHEN event_id % 2 = 1 AND user_id <> 0 AND user_id <> event_id THEN 1 ELSE 0 END, 3)
    - CASE WHEN length(event_type) < 5 THEN 1 ELSE 0 END, 1) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM events""")
def p11_confidence(spark, d):
    told = F.expr("CASE event_type WHEN 'error' THEN 'High' WHEN 'view' THEN 'Low' WHEN 'click' THEN 'Medium' END")
    source = F.expr("if(event_id % 2 = 1, user_id, null)")
    return _read(spark, d, "events").select("event_id", scalars.confidence(told, source, F.col("event_id"), F.col("event_type")).alias("confidence"))


@query(f"""{_SQL_SCANS} SELECT project, CAST(to_json(list({{'scan_id': scan_id, 'total': total, 'critical': critical}} ORDER BY ts, scan_id)) AS VARCHAR) AS value
    FROM (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) <= 20) GROUP BY project""")
def k16_trend_json(spark, d):
    """The limit is the feature: a chart of each project's last twenty scans."""
    return history.as_json(_scans(spark, d), ["scan_id", "total", "critical"], 20)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error'")
def t1_stream_errors(spark, d):
    """A stream of the events' files, each event once, filtered and appended; then what it wrote."""
    source = f"{d}/events.parquet"
    out = f"{graphs.checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    rows = ingest.arrivals(spark, f"{source}*", spark.read.parquet(source).schema, "ts", "event_id")
    ingest.drain(rows, f"{out}/rows", f"{out}/progress", lambda df: df.filter("event_type = 'error'").select("event_id", "user_id", "event_type", "value"))
    return spark.read.parquet(f"{out}/rows")


from lumenfold.plans import audits, concurrency, cross_file, custom_rules, proximity, taint, triage  # noqa: E402, F401  register their queries
