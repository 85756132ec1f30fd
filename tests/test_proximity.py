"""Proximity joins against plain loops, on random rows with nulls, ties, repeated rows and one unit that holds a third."""

import random
from collections import Counter

import pytest

from lumenfold.operators import proximity as px


def rows_of(rng, n, *more, top=400):
    unit = lambda: rng.choice(["a", "a", "a", "b", "c", "d", None])
    return [(unit(), rng.choice([None, *range(-30, top)]), *(m() for m in more)) for _ in range(n)]


@pytest.mark.parametrize("before, after", [(12, -1), (0, 9), (5, 5), (0, 0), (40, -20)])
def test_near(spark, before, after):
    rng = random.Random(before)
    points, marks = rows_of(rng, 150, lambda: rng.randrange(3)), rows_of(rng, 60, lambda: rng.randrange(3))
    points, marks = points + points[:20], marks + marks[:20]
    p, m = (spark.createDataFrame(x, "unit string, place int, field int") for x in (points, marks))

    def met(x):
        return None not in x[:2] and any(None not in y[:2] and (x[0], x[2]) == (y[0], y[2]) and x[1] - before <= y[1] <= x[1] + after for y in marks)

    for missing in (False, True):
        told = px.near(p, m, ["unit", "field"], before, after, missing).collect()
        assert Counter(map(tuple, told)) == Counter(x for x in points if met(x) != missing)
    assert px.near(p, m.limit(0), ["unit", "field"], before, after, True).count() == len(points)
    assert px.near(p.limit(0), m, ["unit", "field"], before, after).count() == 0


@pytest.mark.parametrize("reach", [1, 7, 60])
def test_outgrown(spark, reach):
    rng = random.Random(reach)
    names = lambda: rng.choice([None, [], ["x"], ["y", "x"], ["z", "z"]])
    allocs = rows_of(rng, 120, lambda: rng.randrange(2), names, top=60)
    loops, copies = rows_of(rng, 120, lambda: rng.choice([None, "x", "y", "w"]), top=60), rows_of(rng, 60, top=60)
    want = {}
    for unit, line, pos, known in sorted((a for a in allocs if a[3] and None not in a[:2]), key=lambda a: (*a[:3], sorted(set(a[3])))):
        inside = lambda r: r[0] == unit and r[1] is not None and line <= r[1] < line + reach  # noqa: B023, E731
        found = [r for r in loops if inside(r)]
        others = sorted({r[2] for r in found} - {None} - set(known))
        if others and any(map(inside, copies)):
            want.setdefault((unit, line), (sorted(set(known)), others, min(r[1] for r in found)))
    tables = ((allocs, "unit string, line int, pos int, names array<string>"), (loops, "unit string, line int, bound string"), (copies, "unit string, line int"))
    told = px.outgrown(*(spark.createDataFrame(*t) for t in tables), reach).collect()
    assert len(told) == len(want) and {(r.unit, r.line): (r.names, r.others, r.loop) for r in told} == want
    assert want


def test_overrun(spark):
    rng = random.Random(5)
    size = lambda: rng.choice([None, 0, 4, 8, 16])
    name = lambda: rng.choice(["p", "q", None])
    unit = lambda: rng.choice("aaabc")
    buffers = [(unit(), rng.choice(["stack", "heap"]), name(), rng.randrange(6), size()) for _ in range(25)]
    copies = [(unit(), rng.choice([None, *range(20)]), name(), size()) for _ in range(60)]
    last = {}
    for u, kind, n, pos, s in sorted(buffers, key=lambda b: (b[3], -(2**70) if b[4] is None else -b[4])):
        last[u, kind, n] = s
    want = set()
    for u, line, n, most in copies:
        for kind in ("stack", "heap"):
            if n and (u, kind, n) in last:
                s = last[u, kind, n]
                if s is None or most is None:
                    want |= {(u, line, "potential-stack-overflow", "LOW")} if kind == "stack" else set()
                elif most > s:
                    want.add((u, line, f"{kind}-buffer-overflow", "HIGH"))
    b = spark.createDataFrame(buffers, "unit string, kind string, name string, pos int, size long")
    c = spark.createDataFrame(copies, "unit string, line int, name string, most long")
    told = px.overrun(b, c).collect()
    assert len(told) == len(want) and set(map(tuple, told)) == want
    assert px.overrun(b.limit(0), c).count() == 0 == px.overrun(b, c.limit(0)).count()
