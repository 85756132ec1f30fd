"""Queries of the cross-file operators, each with the SQL that checks it.

Files are made from rows of `part`: file k of one of three languages imports an earlier one of its folder, calls its
function with a name that may be tainted, and defines one whose body is chosen by the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import cross_file, taint
from lumenfold.plans.registry import query, read, spread
from lumenfold.sources.text import lines

_MADE_SQL = """m AS (SELECT p_partkey AS k, p_size AS s, p_partkey - 3 * (1 + p_size % 3) AS t, p_partkey % 3 AS e,
      'proj/d' || p_partkey % 3 || '/m' || p_partkey || ['.c', '.py', '.js'][p_partkey % 3 + 1] AS path,
      CASE p_partkey % 4 WHEN 0 THEN ['getenv', 'input', 'req.body'][p_partkey % 3 + 1] WHEN 1 THEN ['recv', 'os.environ', 'process.env'][p_partkey % 3 + 1]
        WHEN 3 THEN ['fgets', 'input', 'readline'][p_partkey % 3 + 1] END AS source,
      CASE p_partkey % 4 WHEN 3 THEN 'v1' ELSE 'v' || p_size % 2 END AS var FROM part)"""


def made_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content: files of eight lines."""
    k, t = "p_partkey", "(p_partkey - 3 * (1 + p_size % 3))"
    pick = lambda *texts: f"element_at(array({', '.join(texts)}), cast(p_partkey % 3 + 1 as int))"
    path = f"concat('proj/d', {k} % 3, '/m', {k}, " + pick("'.c'", "'.py'", "'.js'") + ")"
    head = pick(f"""concat('#include "../d0/m', {t}, '.c"')""", f"concat('from m', {t}, ' import f', {t})", f"""concat('import {{ f', {t}, ' }} from "./m', {t}, '"')""")
    go = pick(f"concat('int go_', {k}, '_(void) {{')", f"concat('def go_', {k}, '_():')", f"concat('function go_', {k}, '_() {{')")
    zero, one = pick("""'getenv("A");'""", "'input()'", "'req.body;'"), pick("'recv(0);'", "'os.environ'", "'process.env;'")
    taken = f"""CASE p_partkey % 4 WHEN 0 THEN concat('  v', p_size % 2, ' = ', {zero}) WHEN 1 THEN concat('  v', p_size % 2, ' = ', {one})
        WHEN 2 THEN '  v0 = old' ELSE concat('  ', {pick("'fgets'", "'input'", "'readline'")}, '(v1, 9)') END"""
    own = pick(f"concat('int f', {k}, '(char *a, int b) {{')", f"concat('def f', {k}, '(a, b):')", f"concat('function f', {k}, '(a, b) {{')")
    sink, back = pick("'system(a);'", "'eval(a)'", "'eval(a);'"), pick("""'return getenv("X");'""", "'return input()'", "'return req.body;'")
    body = f"CASE p_size % 4 WHEN 0 THEN {sink} WHEN 1 THEN {back} WHEN 2 THEN 'return 0' ELSE concat({sink}, ' ', {back}) END"
    text = f"concat_ws('\\n', {head}, {go}, {taken}, concat('  f', {t}, '(v', p_size div 2 % 2, ', 1)'), '', {own}, {body}, '')"
    return spread(spark, d, "part", "p_partkey").select(F.expr(path).alias("path"), F.expr(text).alias("content"))


@query(f"""WITH {_MADE_SQL}
    SELECT 'cross-file-taint-flow' AS kind, m.path AS source_file, 3::INT AS source_line, m.source AS source_function, x.path AS sink_file, 6::INT AS sink_line, 'f' || x.k AS sink_function,
      4::INT AS call_line, 7.5::DOUBLE AS risk
    FROM m JOIN m x ON x.k = m.t WHERE m.source IS NOT NULL AND m.var = 'v' || m.s // 2 % 2 AND x.s % 4 IN (0, 3)
    UNION ALL
    SELECT 'cross-file-taint-return', x.path, 6, 'f' || x.k, m.path, 0, '(caller)', NULL, 6.5
    FROM m JOIN m x ON x.k = m.t WHERE x.s % 4 IN (1, 3) AND (m.s % 4 IN (0, 3) OR (m.e = 0 AND m.k % 4 = 3))""")
def j20_j21_w4_cross_file_taint(spark, d):
    return cross_file.cross_file_taint(made_files(spark, d))


@query(f"""WITH {_MADE_SQL}
    SELECT path, CASE WHEN e = 2 AND t < 0 THEN './m' || t ELSE 'proj/d' || e || '/m' || t || ['.c', '.py', '.js'][e + 1] END AS target, t >= 0 AS exists FROM m WHERE NOT (e = 1 AND t < 0)""")
def j19_f3_import_targets(spark, d):
    return cross_file.import_targets(made_files(spark, d))


@query(f"""WITH {_MADE_SQL}
    SELECT path, 'f' || k AS func, 6::INT AS line, 2::INT AS n_params, CASE WHEN s % 4 IN (0, 3) THEN '0' ELSE '' END AS tainted, s % 4 IN (0, 3) AS has_sink, s % 4 IN (1, 3) AS returns_tainted FROM m""")
def f13_functions(spark, d):
    """Of each file the last function, the one whose body is its own."""
    told = cross_file.functions(made_files(spark, d)).filter("pos = 1")
    # the second name, b, may be in any word of a body
    first = F.array_join(F.filter("tainted_params", lambda i: i == 0), ",").alias("tainted")
    return told.select("path", "func", "line", F.size("params").alias("n_params"), first, "has_sink", "returns_tainted")


_WORDS_SQL = """l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS t FROM documents),
    n AS (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) AS line FROM l),
    w AS (SELECT doc_id, line, unnest(list_distinct(regexp_extract_all(text, '\\w+'))) AS var FROM n)"""


@query(f"""WITH {_WORDS_SQL}, v AS (SELECT doc_id, var, min(line) AS rank FROM w WHERE length(var) >= 10 GROUP BY ALL)
    SELECT w.doc_id AS unit, 'sink' || w.line % 2 AS issue, w.line // 4 AS line, min((w.line, v.rank, w.var))[1] AS place, min((w.line, v.rank, w.var))[2] AS rank, min((w.line, v.rank, w.var))[3] AS var
    FROM w JOIN v ON v.doc_id = w.doc_id AND v.var = w.var GROUP BY ALL""")
def j10_f7_tainted_arguments(spark, d):
    """Lines of whole texts stand for sinks' arguments, and long words for tainted names, ranked by the line that has them first."""
    text = lines(read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("path", "unit")
    sinks = text.select("unit", F.expr("concat('sink', line % 2)").alias("issue"), F.expr("line div 4").alias("line"), F.col("line").alias("place"), F.col("text").alias("args"))
    words = text.select("unit", "line", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1))).alias("var"))
    return taint.first_tainted_arguments(sinks, words.filter(F.length("var") >= 10).select("unit", "var", F.col("line").alias("rank")))


@query(f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\\w+'), lambda n: regexp_matches(n, '^[a-zA-Z_]') AND n NOT IN ({", ".join(f"'{k}'" for k in taint.KEYWORDS)})), ' ') AS names FROM documents""")
def f10_identifiers(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(taint.identifiers(F.col("text")), " ").alias("names"))
