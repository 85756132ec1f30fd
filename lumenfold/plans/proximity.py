"""Queries of the proximity operators, each with the SQL that checks it: sales' lines and clicks stand for places of units."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import proximity
from lumenfold.plans.registry import query, read

_PLACES_SQL = """l AS (SELECT l_suppkey AS unit, l_orderkey AS line, l_linenumber AS pos, 'n' || l_partkey % 5 AS a, 'n' || l_partkey % 7 AS b, l_partkey % 4 AS kind, l_quantity AS q FROM lineitem)"""
_PLACES = ["l_suppkey AS unit", "l_orderkey AS line", "l_linenumber AS pos", "concat('n', l_partkey % 5) AS a", "concat('n', l_partkey % 7) AS b", "l_partkey % 4 AS kind", "l_quantity AS q"]


@query(f"""WITH {_PLACES_SQL} SELECT unit, line, pos, a FROM l p WHERE kind = 0
    AND NOT EXISTS (SELECT 1 FROM l g WHERE g.kind = 1 AND g.unit = p.unit AND g.a = p.a AND g.line BETWEEN p.line - 1200 AND p.line - 1)""")
def j18_unguarded_loops(spark, d):
    """Loops (kind 0) without a guard (kind 1) of their field in the 1200 places before them."""
    rows = read(spark, d, "lineitem").selectExpr(*_PLACES).withColumn("place", F.col("line"))
    return proximity.near(rows.filter("kind = 0"), rows.filter("kind = 1"), ["unit", "a"], 1200, -1, missing=True).select("unit", "line", "pos", "a")


@query(f"""WITH {_PLACES_SQL},
    f AS (SELECT DISTINCT p.unit, p.line, p.pos, p.a, p.b, o.line AS loop, o.b AS bound FROM l p JOIN l o ON o.unit = p.unit AND o.kind = 1 AND o.line BETWEEN p.line AND p.line + 59
      WHERE p.kind = 0 AND EXISTS (SELECT 1 FROM l c WHERE c.kind = 2 AND c.unit = p.unit AND c.line BETWEEN p.line AND p.line + 59)),
    g AS (SELECT unit, line, pos, list_sort(list_distinct([a, b])) AS names, min(loop) AS loop, list_sort(list_distinct(list(bound) FILTER (bound <> a AND bound <> b))) AS others FROM f GROUP BY ALL),
    k AS (SELECT unit, line, min((pos, names, others, loop)) AS m FROM g WHERE len(others) > 0 GROUP BY ALL)
    SELECT unit, line, array_to_string(m[2], ' ') AS names, array_to_string(m[3], ' ') AS others, m[4] AS loop FROM k""")
def j17_outgrown_allocations(spark, d):
    """Kind 0 allocates by two names, kind 1 loops to a name, kind 2 copies."""
    rows = read(spark, d, "lineitem").selectExpr(*_PLACES)
    allocs = rows.filter("kind = 0").select("unit", "line", "pos", F.array("a", "b").alias("names"))
    told = proximity.outgrown(allocs, rows.filter("kind = 1").withColumnRenamed("b", "bound"), rows.filter("kind = 2"))
    return told.select("unit", "line", F.array_join("names", " ").alias("names"), F.array_join("others", " ").alias("others"), "loop")


@query(f"""WITH {_PLACES_SQL}, s AS (SELECT unit, a, pos, line, CASE WHEN kind = 0 THEN 'stack' ELSE 'heap' END AS kind, CASE WHEN q::INT % 5 > 0 THEN q::BIGINT END AS size FROM l WHERE kind < 2),
    z AS (SELECT unit, a, kind, size FROM s QUALIFY row_number() OVER (PARTITION BY unit, a, kind ORDER BY line * 10 + pos DESC, size NULLS LAST) = 1)
    SELECT DISTINCT l.unit, l.line, CASE WHEN size IS NULL OR q::INT % 7 = 0 THEN 'potential-stack-overflow' ELSE z.kind || '-buffer-overflow' END AS issue, CASE WHEN size IS NULL OR q::INT % 7 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence
    FROM l JOIN z ON z.unit = l.unit AND z.a = l.a WHERE l.kind = 3 AND CASE WHEN size IS NULL OR q::INT % 7 = 0 THEN z.kind = 'stack' ELSE q::BIGINT > size END""")
def j16_x8_overrun_buffers(spark, d):
    """Kinds 0 and 1 are buffers, kind 3 copies into the one of its name."""
    rows = read(spark, d, "lineitem").selectExpr(*_PLACES)
    buffers = rows.filter("kind < 2").selectExpr("unit", "if(kind = 0, 'stack', 'heap') AS kind", "a AS name", "line * 10 + pos AS pos", "if(cast(q AS int) % 5 > 0, cast(q AS long), null) AS size")
    copies = rows.filter("kind = 3").selectExpr("unit", "line", "a AS name", "if(cast(q AS int) % 7 = 0, null, cast(q AS long)) AS most")
    return proximity.overrun(buffers, copies)
