"""Queries of races and misused locks, each with the SQL that checks it: a file of `part`'s each row, its lines, guards and
the distances between them chosen by the row's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.concurrency import concurrency
from lumenfold.plans.registry import query, spread


def _found(spark: SparkSession, d: str, ext: str, lines: list[str]) -> DataFrame:
    """Findings of files whose lines are SQL expressions of k and s."""
    rows = spread(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    files = rows.select(F.expr(f"concat('m', k, '{ext}')").alias("path"), F.concat_ws("\n", *map(F.expr, lines)).alias("content"))
    return concurrency(files).select("path", "line", "issue", "confidence", "name")


def _sql(ext: str, rules: list[tuple[str, str, str, str, str]]) -> str:
    """Rows of (condition, line, issue, confidence, name) of k and s."""
    each = [f"SELECT 'm' || k || '{ext}' AS path, {line}::INT AS line, '{issue}' AS issue, '{sure}' AS confidence, {name}::VARCHAR AS name FROM p WHERE {when}" for when, line, issue, sure, name in rules]
    return "WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) " + " UNION ALL ".join(each)


_THREADS = "(k % 5 <> 4 OR k % 3 = 0 OR s % 5 < 3)"


@query(_sql(".c", [
    ("s % 5 < 3 AND NOT (k % 3 = 0 AND s % 2 = 0)", "10", "race-condition", "MEDIUM", "NULL"),
    ("k % 6 = 0 AND s % 2 = 1", "13", "race-condition", "MEDIUM", "NULL"),
    (f"k % 4 < 2 AND NOT (k % 3 = 0 AND s % 2 = 0) AND {_THREADS}", "8", "data-race", "LOW", "'total_' || k"),
    (f"k % 4 < 2 AND {_THREADS}", "2", "missing-atomic", "MEDIUM", "'total_' || k"),
    ("s % 2 = 0 AND k % 7 < 4", "3", "volatile-misuse", "HIGH", "'stop'"),
    ("s % 4 = 0", "12", "double-checked-locking", "HIGH", "'p'"),
    ("k % 6 = 0", "13", "thread-in-destructor", "HIGH", "NULL"),
]))
def d15_c_races(spark, d):
    return _found(spark, d, ".c", [
        "if(k % 5 <> 4, '#include <pthread.h>', '#include <stdio.h>')",
        "concat('static int total_', k, ' = 0;')",
        "if(s % 2 = 0, 'volatile int stop;', 'int stop;')",
        "'/* pthread_mutex_lock'",
        "'*/ void *work(void *a) {'",
        "if(k % 3 = 0, '    pthread_mutex_lock(&m);', '    lock_none();')",
        "concat('// ', repeat('.', if(s % 2 = 1, 1600, 20)))",
        "concat('    total_', k, if(k % 4 < 2, '++;', ';'))",
        "if(k % 7 < 4, '    while (!stop) { }', '    go();')",
        "if(s % 5 < 3, '  pthread_create(&t, 0, work, 0);', '  none();')",
        "'}'",
        "if(s % 4 = 0, 'if (p == NULL) { lock(); p = q; if (p == 0) { } }', 'if (p == NULL) { lock(); } p = q; if (p == 0) { }')",
        "if(k % 6 = 0, '~Pool() { pthread_create(&t, 0, work, 0); }', '~Pool() { }')",
    ])


@query(_sql(".java", [
    ("k % 4 = 0 AND s % 2 = 0 AND k % 3 <> 0", "2", "unsynchronized-thread", "MEDIUM", "'W' || k"),
    ("k % 3 <> 0 OR s % 3 = 0", "6", "wait-outside-sync", "HIGH", "NULL"),
    ("k % 5 < 2 AND s % 4 < 2", "9", "unsafe-iteration", "HIGH", "NULL"),
    ("k % 2 = 0", "12", "unsynchronized-hashmap", "LOW", "NULL"),
    ("k % 7 <> 0 AND s % 5 <> 0", "13", "double-checked-locking", "HIGH", "'q'"),
]))
def d15_java_races(spark, d):
    return _found(spark, d, ".java", [
        "'import java.util.*;'",
        "concat('class W', k, if(k % 4 = 0, ' extends Thread {', ' {'))",
        "if(s % 2 = 0, 'private int n;', 'int n;')",
        "if(k % 3 = 0, 'synchronized void b() { }', '/* synchronized */ void b() { }')",
        "concat('// ', repeat('.', if(s % 3 = 0, 600, 6)))",
        "'void a() { x.notifyAll(); }'",
        "'}'",
        "'class U {'",
        "if(k % 5 < 2, 'List l = Collections.synchronizedList(y);', 'List l;')",
        "if(s % 4 < 2, 'for (Object o : l) { }', 'l.size();')",
        "concat('// ', repeat('.', 600))",
        "concat('Map m = new HashMap<String, String>(); ', if(s % 5 = 0, 'volatile Q q;', 'Q q;'))",
        "if(k % 7 <> 0, 'if (q == null) { synchronized (this) { if (q == null) { } } }', 'none();')",
        "if(k % 2 = 0, 'new Thread(r).start();', 'r.run();')",
        "'}'",
    ])


@query(_sql(".go", [
    ("k % 3 <> 0 AND (s % 3 < 2 OR k % 4 = 0)", "2", "concurrent-map-write", "MEDIUM", "NULL"),
    ("s % 3 = 0", "6", "goroutine-loop-closure", "HIGH", "'v' || s"),
    ("k % 4 = 0", "7", "waitgroup-add-in-goroutine", "HIGH", "NULL"),
    ("k % 5 < 3 AND s % 2 = 1 AND (s % 3 < 2 OR k % 4 = 0)", "9", "unbuffered-channel-block", "LOW", "NULL"),
]))
def d15_go_races(spark, d):
    return _found(spark, d, ".go", [
        "'package main'",
        "'var m map[string]int'",
        "if(k % 3 = 0, 'var mu sync.Mutex', 'var mu int // sync.Mutex')",
        "concat('// ', repeat('.', 300))",
        "'func run() {'",
        """concat('for _, v', s, ' := range xs { go ', CASE s % 3 WHEN 0 THEN concat('func() { use(v', s, ', 1) }() }')
            WHEN 1 THEN concat('func(x int) { use(x, 1) }(v', s, ') }') ELSE concat('use(v', s, ', 1) }') END)""",
        "if(k % 4 = 0, 'go func() { wg.Add(1) }()', 'wg.Add(1)')",
        "concat('// select ', repeat('.', 300))",
        "if(k % 5 < 3, 'ch <- 1', 'x()')",
        "if(s % 2 = 0, 'select { }', '}')",
    ])


@query(_sql(".py", [
    ("s % 3 < 2 AND s % 2 = 0 AND k % 3 <> 0", "5", "thread-unsafe-mutation", "MEDIUM", "NULL"),
    ("k % 4 IN (0, 3)", "7", "missing-await", "HIGH", "CASE WHEN k % 4 = 0 THEN 'load' || s || '_async' ELSE 'aiofiles' END"),
    ("k % 5 < 3 AND s % 4 <> 0", "8", "multiprocess-unshared", "LOW", "NULL"),
    ("s % 3 = 0", "2", "non-daemon-thread", "LOW", "NULL"),
]))
def d15_python_races(spark, d):
    return _found(spark, d, ".py", [
        "'import threading'",
        "CASE s % 3 WHEN 0 THEN 't = threading.Thread(target=f)' WHEN 1 THEN 't = threading.Thread(target=f, daemon=True)' ELSE 't = None # Thread()' END",
        "if(k % 3 = 0, 'lock = threading.Lock()', 'lock = 1 # threading.Lock')",
        "concat('# ', repeat('.', if(s % 2 = 1, 1200, 1)))",
        "if(k % 2 = 0, 'xs.append(1)', 'd[1] = 2')",
        "'async def go_():'",
        """CASE k % 4 WHEN 0 THEN concat('    load', s, '_async(1)') WHEN 1 THEN '    await load_async(1)' WHEN 2 THEN '    load_async(1)  # fine' ELSE '    aiofiles(2)' END""",
        "if(k % 5 < 3, 'p = multiprocessing.Process(target=f)', 'p = 1')",
        "if(s % 4 = 0, 'm = Manager()', 'm = 2')",
    ])
