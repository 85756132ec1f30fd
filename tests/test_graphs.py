"""Cones that are deeper than 50 rounds, and cyclic."""

from lumenfold.operators import graphs


def test_cone_follows_long_paths_and_cycles_to_the_end(spark):
    edges = [(i, i + 1) for i in range(55)] + [(55, 0), (3, 3), (90, 91)]
    rows = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
    told = graphs.cone(rows, spark.createDataFrame([(0,)], "node long").coalesce(1)).collect()
    assert sorted((r.node, r.depth) for r in told) == [(i, i) for i in range(56)]
