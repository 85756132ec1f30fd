"""Queries of the taint operators, each with the SQL that checks it.

Statements and calls are made from rows of `customer` and `part`: every row is a statement of a block, or a call of a
function, with names chosen by its numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import taint
from lumenfold.plans.registry import query, spread, values

_FLOW_SQL = """edges AS (SELECT DISTINCT c_custkey // 12 AS func, c_custkey % 12 AS src, (c_custkey % 12 * 5 + c_nationkey) % 12 AS dst FROM customer
      UNION SELECT c_custkey // 12, c_custkey % 12, (c_custkey + 1) % 12 FROM customer WHERE c_nationkey % 2 = 0)"""
_MADE_SQL = """made AS (
      SELECT c_custkey // 12 AS func, c_custkey % 12 AS block, 0 AS pos, c_custkey * 2 AS line,
        CASE WHEN c_nationkey % 5 = 4 THEN 'call' ELSE 'assign' END AS kind, ['v' || (c_custkey * 7 % 5)] AS defs, ['v' || (c_nationkey % 5)] AS uses,
        CASE WHEN c_nationkey % 6 = 0 THEN 'src' || (c_custkey % 3) END AS source, c_nationkey % 8 = 3 AS cleans, CAST(NULL AS VARCHAR) AS sink, CAST([] AS VARCHAR[]) AS args FROM customer
      UNION ALL
      SELECT c_custkey // 12, c_custkey % 12, 1, c_custkey * 2 + 1, CASE WHEN c_custkey % 3 = 0 THEN 'call' ELSE 'decl' END,
        CASE WHEN c_custkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['v' || (c_nationkey * 3 % 5), 'w'] END, ['v' || ((c_custkey + c_nationkey) % 5), 'w'],
        CASE WHEN c_custkey % 9 = 0 THEN 'ret' END, false, CASE WHEN c_custkey % 3 = 0 THEN 'sink' || (c_nationkey % 4) END, ['v' || ((c_custkey + c_nationkey) % 5), 'w', 'u'] FROM customer)"""
# `recurring` is all that is known so far: a fact at an assignment of its own variable goes on if another one is used there
_FACTS_SQL = """facts(func, block, pos, var, line, source) USING KEY (func, block, pos, var, line, source) AS (
      SELECT DISTINCT func, block, 2, unnest(CASE WHEN len(defs) > 0 THEN defs ELSE ['__ret_' || line] END), line, source FROM made WHERE source IS NOT NULL
      UNION
      SELECT DISTINCT n.* FROM (
        SELECT f.func, e.dst AS block, 0 AS pos, f.var, f.line, f.source FROM recurring.facts f JOIN edges e ON e.func = f.func AND e.src = f.block WHERE f.pos = 2
        UNION ALL
        SELECT f.func, f.block, f.pos + 1, f.var, f.line, f.source FROM recurring.facts f JOIN made s ON s.func = f.func AND s.block = f.block AND s.pos = f.pos
          WHERE NOT (list_contains(s.defs, f.var) AND s.cleans AND s.kind IN ('assign', 'call'))
            AND (s.kind = 'call' OR NOT list_contains(s.defs, f.var)
                 OR EXISTS (SELECT 1 FROM recurring.facts g WHERE g.func = s.func AND g.block = s.block AND g.pos = s.pos AND list_contains(s.uses, g.var)))
        UNION ALL
        SELECT f.func, f.block, f.pos + 1, d.d, f.line, f.source FROM recurring.facts f JOIN made s ON s.func = f.func AND s.block = f.block AND s.pos = f.pos, unnest(s.defs) AS d(d)
          WHERE s.kind <> 'call' AND list_contains(s.uses, f.var) AND NOT s.cleans
        UNION ALL
        SELECT f.func, f.block, 2, f.var, f.line, f.source FROM recurring.facts f WHERE f.pos = 0 AND NOT EXISTS (SELECT 1 FROM made s WHERE s.func = f.func AND s.block = f.block)
      ) n WHERE NOT EXISTS (SELECT 1 FROM recurring.facts k WHERE k.func = n.func AND k.block = n.block AND k.pos = n.pos AND k.var = n.var AND k.line = n.line AND k.source = n.source))"""


def made_flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Statements and edges of functions of twelve blocks."""
    rows = spread(spark, d, "customer", "c_custkey")
    place = ["c_custkey div 12 AS func", "c_custkey % 12 AS block"]
    none = "cast(array() AS array<string>)"
    one = rows.selectExpr(
        *place, "0 AS pos", "c_custkey * 2 AS line", "CASE WHEN c_nationkey % 5 = 4 THEN 'call' ELSE 'assign' END AS kind", "array('v' || (c_custkey * 7 % 5)) AS defs",
        "array('v' || (c_nationkey % 5)) AS uses", "CASE WHEN c_nationkey % 6 = 0 THEN 'src' || (c_custkey % 3) END AS source", "c_nationkey % 8 = 3 AS cleans",
        "cast(NULL AS string) AS sink", f"{none} AS args",
    )
    two = rows.selectExpr(
        *place, "1 AS pos", "c_custkey * 2 + 1 AS line", "CASE WHEN c_custkey % 3 = 0 THEN 'call' ELSE 'decl' END AS kind",
        f"CASE WHEN c_custkey % 3 = 0 THEN {none} ELSE array('v' || (c_nationkey * 3 % 5), 'w') END AS defs", "array('v' || ((c_custkey + c_nationkey) % 5), 'w') AS uses",
        "CASE WHEN c_custkey % 9 = 0 THEN 'ret' END AS source", "false AS cleans", "CASE WHEN c_custkey % 3 = 0 THEN 'sink' || (c_nationkey % 4) END AS sink",
        "array('v' || ((c_custkey + c_nationkey) % 5), 'w', 'u') AS args",
    )
    jumps = rows.selectExpr("c_custkey div 12 AS func", "c_custkey % 12 AS src", "(c_custkey % 12 * 5 + c_nationkey) % 12 AS dst")
    nexts = rows.filter("c_nationkey % 2 = 0").selectExpr("c_custkey div 12 AS func", "c_custkey % 12 AS src", "(c_custkey + 1) % 12 AS dst")
    return one.union(two), jumps.union(nexts).distinct()


@query(f"WITH RECURSIVE {_FLOW_SQL}, {_MADE_SQL}, {_FACTS_SQL} SELECT DISTINCT func, block, var, line, source FROM facts WHERE pos = 2")
def g8_taint_with_kills(spark, d):
    return taint.held_behind(*made_flow(spark, d))


@query(f"""WITH RECURSIVE {_FLOW_SQL}, {_MADE_SQL}, {_FACTS_SQL},
    r AS (SELECT DISTINCT func, 1::BIGINT AS node FROM edges UNION SELECT r.func, e.dst FROM r JOIN edges e ON e.func = r.func AND e.src = r.node),
    a AS (SELECT func, node AS dom, 1::BIGINT AS node FROM r WHERE node <> 1 UNION SELECT a.func, a.dom, e.dst FROM a JOIN edges e ON e.func = a.func AND e.src = a.node WHERE e.dst <> a.dom),
    guards AS (SELECT DISTINCT func, block, unnest(defs) AS var FROM made WHERE cleans),
    hits AS (SELECT DISTINCT s.func, s.block, s.line, s.sink, f.var, f.line AS source_line, f.source
      FROM made s JOIN facts f ON f.func = s.func AND f.block = s.block AND f.pos = 2 AND list_contains(s.args, f.var) WHERE s.sink IS NOT NULL)
    SELECT DISTINCT h.func, h.line, h.sink, h.var, h.source_line, h.source, EXISTS (
      SELECT 1 FROM guards g JOIN r x ON x.func = g.func AND x.node = g.block JOIN r y ON y.func = g.func AND y.node = h.block
      WHERE g.func = h.func AND g.var = h.var AND NOT EXISTS (SELECT 1 FROM a WHERE a.func = g.func AND a.dom = g.block AND a.node = h.block)) AS sanitised FROM hits h""")
def g9_x3_tainted_sinks(spark, d):
    statements, edges = made_flow(spark, d)
    return taint.tainted_sinks(statements, edges, edges.select("func", F.lit(1).cast("long").alias("node")).distinct())


_CALLS_SQL = """functions AS (
      SELECT DISTINCT p_partkey // 40 AS unit, CASE WHEN p_partkey % 8 = 0 THEN 'main' ELSE 'f' || (p_partkey % 8) END AS func,
        CASE WHEN p_partkey % 8 = 0 THEN ['argc', 'argv'] ELSE ['a', 'b' || (p_partkey % 8), 'c'] END AS params FROM part),
    calls AS (
      SELECT p_partkey // 40 AS unit, CASE WHEN p_partkey % 8 = 0 THEN 'main' ELSE 'f' || (p_partkey % 8) END AS func, p_partkey AS line,
        CASE p_size % 7 WHEN 0 THEN 'recv' WHEN 1 THEN 'system' WHEN 2 THEN 'memcpy' ELSE 'f' || (p_partkey * p_size % 8) END AS callee,
        CASE p_size % 4 WHEN 0 THEN ['&buf' || (p_partkey % 2), 'x + 1'] WHEN 1 THEN ['strlen(a)', 'b' || (p_partkey % 8) || '[0]', 'k']
          WHEN 2 THEN ['argv[1]', 'n', 'buf1'] ELSE [' c ', 'buf0->len, argc', 'a'] END AS args FROM part),
    tokens AS (SELECT DISTINCT unit, func, line, callee, position - 1 AS position, unnest(regexp_extract_all(arg, '\\w+')) AS token
      FROM (SELECT unit, func, line, callee, unnest(args) AS arg, generate_subscripts(args, 1) AS position FROM calls)),
    params AS (SELECT unit, func, unnest(params) AS param, generate_subscripts(params, 1) - 1 AS position FROM functions)"""
_SINKS_SQL = f"sinks(callee, issue) AS (VALUES {values(list(taint.SINKS.items()))})"
_NAMES_SQL = f"""names AS (
      SELECT unit, func, regexp_extract(regexp_replace(trim(arg), '^&+', ''), '^(\\w+)$', 1) AS var
        FROM (SELECT unit, func, unnest(args) AS arg FROM calls WHERE callee IN ({", ".join(f"'{s}'" for s in taint.SOURCES)})) WHERE var <> ''
      UNION SELECT unit, func, param FROM params WHERE func = 'main' AND param IN ('argv', 'argc')
      UNION SELECT p.unit, p.func, p.param FROM names n JOIN tokens t ON t.unit = n.unit AND t.func = n.func AND t.token = n.var
        JOIN params p ON p.unit = t.unit AND p.func = t.callee AND p.position = t.position)"""


def made_calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Functions and calls of units of up to forty calls."""
    rows = spread(spark, d, "part", "p_partkey")
    func = "CASE WHEN p_partkey % 8 = 0 THEN 'main' ELSE 'f' || (p_partkey % 8) END AS func"
    functions = rows.selectExpr("p_partkey div 40 AS unit", func, "CASE WHEN p_partkey % 8 = 0 THEN array('argc', 'argv') ELSE array('a', 'b' || (p_partkey % 8), 'c') END AS params")
    callee = "CASE p_size % 7 WHEN 0 THEN 'recv' WHEN 1 THEN 'system' WHEN 2 THEN 'memcpy' ELSE 'f' || (p_partkey * p_size % 8) END AS callee"
    args = """CASE p_size % 4 WHEN 0 THEN array('&buf' || (p_partkey % 2), 'x + 1') WHEN 1 THEN array('strlen(a)', 'b' || (p_partkey % 8) || '[0]', 'k')
        WHEN 2 THEN array('argv[1]', 'n', 'buf1') ELSE array(' c ', 'buf0->len, argc', 'a') END AS args"""
    return functions.distinct(), rows.selectExpr("p_partkey div 40 AS unit", func, "p_partkey AS line", callee, args)


@query(f"WITH RECURSIVE {_CALLS_SQL}, {_NAMES_SQL} SELECT DISTINCT unit, func, var FROM names")
def g14_tainted_names(spark, d):
    return taint.tainted_names(*made_calls(spark, d))


@query(f"""WITH RECURSIVE {_CALLS_SQL}, {_SINKS_SQL}, {_NAMES_SQL}
    SELECT t.unit, s.issue, t.line, min(t.func) AS func FROM tokens t JOIN sinks s USING (callee) JOIN names n ON n.unit = t.unit AND n.func = t.func AND n.var = t.token GROUP BY ALL""")
def g15_sink_violations(spark, d):
    return taint.sink_violations(*made_calls(spark, d))


@query(f"""WITH RECURSIVE {_CALLS_SQL}, {_SINKS_SQL},
    uses AS (SELECT t.unit, t.func, p.position, t.callee, t.position AS given FROM tokens t JOIN params p ON p.unit = t.unit AND p.func = t.func AND p.param = t.token),
    told AS (SELECT unit, func, position, issue FROM uses JOIN sinks USING (callee)
      UNION SELECT u.unit, u.func, u.position, t.issue FROM told t JOIN uses u ON u.unit = t.unit AND u.callee = t.func AND u.given = t.position)
    SELECT DISTINCT unit, func, position, issue FROM told""")
def g10_x9_summaries(spark, d):
    return taint.summaries(*made_calls(spark, d))
