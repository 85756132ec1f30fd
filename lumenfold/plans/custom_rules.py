"""Queries of users' rules, each with the SQL that checks it: a rule of `supplier`'s each row, a file of `part`'s each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import custom_rules
from lumenfold.plans.registry import query, read

_RULES_SQL = """r AS (SELECT s_suppkey AS j, 'R' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'LOW' WHEN s_suppkey % 4 = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, s_nationkey % 3 AS kind FROM supplier)"""


def made_rules(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a rule file for each supplier."""
    text = """concat('# rules\\nrules:\\n  - id: "R', s_suppkey, '"\\n    pattern: "fn', s_suppkey, '_\\\\w*\\\\s*\\\\("\\n    message: ''no: call''\\n',
        CASE WHEN s_suppkey % 4 = 0 THEN '    severity: low\\n' WHEN s_suppkey % 4 = 1 THEN '' ELSE '    severity: HIGH\\n' END,
        CASE s_nationkey % 3 WHEN 0 THEN '    languages: [c, python]\\n' WHEN 1 THEN '    languages:\\n      - java\\n' ELSE '' END, '    cwe: CWE-', s_nationkey, '\\n  - id: broken\\n    pattern: "("\\n')"""
    return read(spark, d, "supplier").select(F.expr("concat('r', s_suppkey, '.yml')").alias("path"), F.expr(text).alias("content"))


@query(f"""WITH {_RULES_SQL} SELECT id, 'fn' || j || '_\\w*\\s*\\(' AS pattern, 'no: call' AS message, severity,
    CASE kind WHEN 0 THEN 'c,python' WHEN 1 THEN 'java' ELSE '' END AS languages, 'CWE-' || s_nationkey AS cwe, '' AS fix FROM r JOIN supplier ON s_suppkey = j""")
def s27_custom_rules(spark, d):
    return custom_rules.read_rules(made_rules(spark, d)).withColumn("languages", F.array_join("languages", ","))


@query(f"""WITH {_RULES_SQL}, n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
    f AS (SELECT 'm' || p_partkey || ['.c', '.py', '.java', '.txt'][p_partkey % 4 + 1] AS path, p_partkey % 4 AS e, p_partkey % n AS a, p_size % n AS b FROM part, n),
    c AS (SELECT path, e, 2 AS line, a AS j, 'x = fn' || a || '_go (1)' AS snippet FROM f UNION ALL SELECT path, e, 4, b, 'my_fn' || b || '_(2);' FROM f)
    SELECT c.path, c.line::INT AS line, r.id, r.severity, c.snippet FROM c JOIN r USING (j) WHERE r.kind = 2 OR c.e = 3 OR (r.kind = 0 AND c.e IN (0, 1)) OR (r.kind = 1 AND c.e = 2)""")
def d20_e1_custom_scan(spark, d):
    rules = custom_rules.read_rules(made_rules(spark, d))
    n = read(spark, d, "supplier").agg((F.max("s_suppkey") + 1).alias("n")).first().n  # one number
    text = f"concat('head\\n  x = fn', p_partkey % {n}, '_go (1)\\nfn_none(1)\\nmy_fn', p_size % {n}, '_(2);\\n')"
    files = read(spark, d, "part").select(F.expr("concat('m', p_partkey, element_at(array('.c', '.py', '.java', '.txt'), cast(p_partkey % 4 + 1 as int)))").alias("path"), F.expr(text).alias("content"))
    return custom_rules.custom_scan(files, rules).select("path", "line", "id", "severity", "snippet")
