"""Fixpoints over the flow graphs of many functions at once: reachability, dominators, reaching definitions.

Edges are (func, src, dst). Every fixpoint is semi-naive: a round joins only the facts that the last one found, and
its new facts are checkpointed once. Rounds follow the longest chain within a function, not the number of functions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.graphs import checkpoints
from lumenfold.operators.joins import joined


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """The least set that holds the seed and all that step (facts -> facts of the same columns) makes of it.

    Step must treat rows one by one. Raises where the rounds do not end, so that no result is cut short.
    """
    checkpoints(seed.sparkSession)
    last = seed.distinct().checkpoint()
    seen = last
    for _ in range(most_rounds):
        last = joined(step(last).select(*seed.columns).distinct(), seen, seed.columns, "left_anti").checkpoint()
        if last.isEmpty():
            return seen.checkpoint()
        seen = seen.union(last)
    raise RuntimeError(f"no fixpoint in {most_rounds} rounds")


def _steps(edges: DataFrame) -> DataFrame:
    """func, __at, __to, made once for all rounds."""
    checkpoints(edges.sparkSession)
    return edges.select("func", F.col("src").alias("__at"), F.col("dst").alias("__to")).distinct().checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """func, src, dst: every pair with a path of one edge or more."""
    on = _steps(edges)

    def step(facts: DataFrame) -> DataFrame:
        met = joined(facts.withColumnRenamed("dst", "__at"), on, ["func", "__at"])
        return met.select("func", "src", F.col("__to").alias("dst"))

    return fixpoint(edges.select("func", "src", "dst"), step)


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, node, dom: each node that its function's entry (func, node) reaches, with all that dominate it, itself too.

    A function's graph is solved in one task, as sets of bits: a node's dominators are itself and what all its
    predecessors' sets share, over and over in an order that follows the edges until nothing changes. No two functions
    meet, and no pair of nodes is a row before it is a result. A function must fit a task (n nodes take n * n bits).
    """
    arcs = edges.select("func", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(False).alias("entry"))
    seeds = entries.select("func", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("entry"))
    kinds = dict(arcs.dtypes)

    def solved(told: pd.DataFrame) -> pd.DataFrame:
        onward: dict = defaultdict(list)
        for a, b, entry in zip(told.a, told.b, told.entry, strict=True):
            if not entry:
                onward[a].append(b)
        order, seen, roots = [], set(), set(told.a[told.entry])
        for root in sorted(roots):
            stack = [] if root in seen else [(root, iter(onward[root]))]
            seen.add(root)
            while stack:
                node, rest = stack[-1]
                step = next((n for n in rest if n not in seen), None)
                if step is None:
                    order.append(stack.pop()[0])
                else:
                    seen.add(step)
                    stack.append((step, iter(onward[step])))
        order.reverse()
        at = {n: k for k, n in enumerate(order)}
        back: list[list[int]] = [[] for _ in order]
        for a in order:
            for b in onward[a]:
                back[at[b]].append(at[a])
        every = (1 << len(order)) - 1
        held = [1 << k if n in roots else every for k, n in enumerate(order)]
        changed = True
        while changed:
            changed = False
            for k, n in enumerate(order):
                if n not in roots:
                    now = every
                    for p in back[k]:
                        now &= held[p]
                    now |= 1 << k
                    changed |= now != held[k]
                    held[k] = now
        pairs = [(n, order[d]) for k, n in enumerate(order) for d in range(len(order)) if held[k] >> d & 1]
        return pd.DataFrame({"func": [told.func.iloc[0]] * len(pairs), "node": [p[0] for p in pairs], "dom": [p[1] for p in pairs]})

    whole = arcs.unionByName(seeds).groupBy("func")
    return whole.applyInPandas(solved, f"func {kinds['func']}, node {kinds['a']}, dom {kinds['a']}")


def reaching(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """func, var, def, node: definitions (func, node, var) that hold when node begins; a new one of the same var ends them."""
    on = _steps(edges)
    defs = defs.select("func", "node", "var").distinct().checkpoint()

    def onward(out: DataFrame) -> DataFrame:
        met = joined(out.withColumnRenamed("node", "__at"), on, ["func", "__at"])
        return met.select("func", "var", "def", F.col("__to").alias("node"))

    seed = onward(defs.select("func", "var", F.col("node").alias("def"), "node"))
    return fixpoint(seed, lambda facts: onward(joined(facts, defs, ["func", "node", "var"], "left_anti")))
