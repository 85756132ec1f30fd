"""Nulls, empty texts and broken inputs of the parsers and fixpoints."""

import pytest

from lumenfold.operators import flow
from lumenfold.sources import diffs, manifests

ODD = [None, "", "[", ")", "require (", "= \"1\"", "a = \"\"", "\r\n", "x" * 100_000, "[]", '{"dependencies": 3}', "<dependency></dependency>", "[dependencies]", "dependencies = ["]


@pytest.mark.parametrize("parse", [manifests.pyproject, manifests.cargo, manifests.go_mod, manifests.gradle, manifests.package_json, manifests.pom])
def test_odd_files_hold_no_dependency(spark, parse):
    rows = spark.createDataFrame([("p", t, 1) for t in ODD], "path string, content string, name int")
    assert parse(rows).collect() == []


def test_numstat_of_odd_lines(spark):
    rows = spark.createDataFrame([("-\t-\ta.png",), ("7\t0\tb c.txt",), ("alone",), ("x\t1\tq",)], "text string")
    assert sorted(map(tuple, diffs.numstat(rows).collect())) == [("a.png", 0, 0), ("alone", 0, 0), ("b c.txt", 7, 0), ("q", 0, 1)]


def test_fixpoints_of_no_edges_and_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 1, 1)], "func int, src int, dst int")
    entries = spark.createDataFrame([(1, 0), (2, 5)], "func int, node int")
    assert flow.closure(edges.limit(0)).count() == 0
    want = [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (1, 2, 2), (2, 5, 5)]
    assert sorted(map(tuple, flow.dominators(edges, entries).collect())) == want
    defs = spark.createDataFrame([(1, 0, "v"), (1, 2, "v")], "func int, node int, var string")
    got = sorted(map(tuple, flow.reaching(edges, defs).select("def", "node").collect()))
    assert got == [(0, 1), (0, 2), (2, 1), (2, 2)]
