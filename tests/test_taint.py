"""Taint with kills and through calls against plain loops, on random graphs with odd rows."""

import random
import re

import pytest

from lumenfold.operators import taint

STATEMENTS = "func long, block long, pos int, line long, kind string, defs array<string>, uses array<string>, source string, cleans boolean, sink string, args array<string>"


def made(seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    rows, edges = [], []
    for func in range(4):
        for block in range(1, 7):
            for pos in range(rng.randrange(4)):
                pick = lambda: rng.choice([None, [], *([rng.sample(names, rng.randrange(1, 3))] * 4)])
                rows.append((
                    func, block, pos, func * 1000 + block * 10 + pos, rng.choice(["assign", "decl", "call", "other"]), pick(), pick(),
                    rng.choice([None, None, None, "recv", "read"]), rng.choice([None, False, False, True]), rng.choice([None, "system"]), rng.sample([*names, None], 2),
                ))
            edges += [(func, block, rng.randrange(1, 8)) for _ in range(rng.randrange(3))]
    return rows, edges + edges[:2]


def plain(rows, edges):
    """Facts at the ends of blocks, by rounds over all blocks until nothing changes, statement by statement."""
    blocks = {(r[0], r[1]) for r in rows} | {(f, x) for f, a, b in edges for x in (a, b)}
    own = {k: set() for k in blocks}
    for func, block, _, line, kind, defs, _, source, *_ in rows:
        if source is not None and kind in ("assign", "decl", "call"):
            own[func, block] |= {(v, line, source) for v in (defs or [f"__ret_{line}"])}
    out = {k: set(v) for k, v in own.items()}
    while True:
        before = {k: set(v) for k, v in out.items()}
        for func, block in blocks:
            held = set().union(*(out[f, a] for f, a, b in edges if (f, b) == (func, block)))
            for r in sorted((r for r in rows if r[:2] == (func, block)), key=lambda r: r[2]):
                kind, defs, uses, cleans = r[4], set(r[5] or []), set(r[6] or []), r[8]
                if kind in ("assign", "decl") and defs:
                    used = {f for f in held if f[0] in uses}
                    held = held | {(d, *f[1:]) for d in defs for f in used} if used else {f for f in held if f[0] not in defs}
                if kind in ("assign", "call") and cleans:
                    held = {f for f in held if f[0] not in defs}
            out[func, block] = held | own[func, block]
        if out == before:
            return {(*k, *f) for k, v in out.items() for f in v}


def reachable(func, edges, without=None):
    seen, todo = set(), [] if without == 1 else [1]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for f, a, b in edges if f == func and a == n and b != without]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_taint_with_kills(spark, seed):
    rows, edges = made(seed)
    statements = spark.createDataFrame(rows, STATEMENTS)
    arcs = spark.createDataFrame(edges, "func long, src long, dst long")
    facts = plain(rows, edges)
    assert set(map(tuple, taint.held_behind(statements, arcs).collect())) == facts
    want = set()
    for func, block, _, line, *_, sink, args in rows:
        for f, b, var, at, source in facts if sink else ():
            if (f, b) == (func, block) and var in args:
                guards = [r[1] for r in rows if r[0] == func and r[8] and var in (r[5] or [])]
                safe = any(g in reachable(func, edges) and block in reachable(func, edges) and block not in reachable(func, edges, g) for g in guards)
                want.add((func, line, sink, var, at, source, safe))
    entries = spark.createDataFrame([(f, 1) for f in range(4)], "func long, node long")
    told = taint.tainted_sinks(statements, arcs, entries).collect()
    assert sorted(map(tuple, told)) == sorted(want) and want


def test_taint_of_empty_tables(spark):
    statements, arcs = spark.createDataFrame([], STATEMENTS), spark.createDataFrame([], "func long, src long, dst long")
    assert taint.tainted_sinks(statements, arcs, spark.createDataFrame([], "func long, node long")).count() == 0
    calls = spark.createDataFrame([], "unit long, func string, line long, callee string, args array<string>")
    functions = spark.createDataFrame([], "unit long, func string, params array<string>")
    assert taint.sink_violations(functions, calls).count() == taint.summaries(functions, calls).count() == 0


def test_taint_through_calls(spark):
    rng = random.Random(3)
    funcs = [(u, f"f{k}", rng.sample(["p", "q", "r"], 2)) for u in range(3) for k in range(6)] + [(u, "main", ["argc", "argv"]) for u in range(3)]
    args = ["p", "q", "&r", "argv[1]", " buf ", "p + q", "", "g(r, 1)", "x"]
    calls = [
        (u, f, 100 * u + k, rng.choice(["recv", "system", "memcpy", "puts", "f0", "f1", "f2", "f3", "f4", "f5"]), [rng.choice(args) for _ in range(rng.randrange(4))])
        for u, f, _ in funcs for k in range(4)
    ]
    params = {(u, f): p for u, f, p in funcs}
    names = {(u, f, v) for u, f, p in funcs if f == "main" for v in p}
    names |= {(u, f, a.strip().lstrip("&")) for u, f, _, c, told in calls if c in taint.SOURCES for a in told if re.fullmatch(r"\w+", a.strip().lstrip("&"))}
    while True:
        more = {
            (u, c, params[u, c][k]) for u, f, _, c, told in calls if (u, c) in params for k, a in enumerate(told)
            if k < len(params[u, c]) and any((u, f, w) in names for w in re.findall(r"\w+", a))
        }
        if more <= names:
            break
        names |= more
    functions = spark.createDataFrame(funcs, "unit long, func string, params array<string>")
    rows = spark.createDataFrame(calls, "unit long, func string, line long, callee string, args array<string>")
    told = taint.tainted_names(functions, rows)
    assert set(map(tuple, told.collect())) == names
    want = {(u, taint.SINKS[c], n) for u, f, n, c, told in calls if c in taint.SINKS and any((u, f, w) in names for a in told for w in re.findall(r"\w+", a))}
    assert {tuple(r)[:3] for r in taint.sink_violations(functions, rows, told).collect()} == want and want
