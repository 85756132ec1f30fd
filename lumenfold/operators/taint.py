"""Taint over flow graphs, with kills and dominating sanitisers, and through calls, by argument positions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import flow
from lumenfold.operators.joins import joined

# Calls that bring data in from outside, and calls that must not get such data (fixed values).
SOURCES = ["argv", "getenv", "gets", "fgets", "recv", "recvfrom", "read", "scanf", "fscanf", "sscanf", "getline"]
SINKS = {
    "strcpy": "stack-buffer-overflow",
    "strcat": "stack-buffer-overflow",
    "sprintf": "format-string",
    "memcpy": "heap-buffer-overflow",
    "memset": "heap-buffer-overflow",
    "system": "os-command-injection",
    "popen": "os-command-injection",
    "execve": "os-command-injection",
    "execvp": "os-command-injection",
    "printf": "format-string",
    "fprintf": "format-string",
}
# Functions whose parameters of these names come from outside (fixed values).
MAINS, FROM_OUTSIDE = ["main", "wmain"], ["argv", "argc"]
# Kinds of statements that give a variable a value, that may bring data in, and that a sanitiser's call ends taint in
# (fixed values).
ASSIGNS, SEEDS, CLEANS = ["assign", "decl"], ["assign", "decl", "call"], ["assign", "call"]

#: Functions that a task holds as Python values at a time.
SLICE = 256


def _passed(held: set[tuple], body: list[dict]) -> set[tuple]:
    """What holds behind a block's statements, in order, of what holds before them: facts (var, line, source).

    A statement that gives variables a value from tainted ones taints them, besides what they had; from others it ends
    their taint; so does a sanitiser's call.
    """
    for s in body:
        if s["assigns"]:
            used = [f for f in held if f[0] is not None and f[0] in s["uses"]]
            held = held | {(d, *f[1:]) for f in used for d in s["defs"]} if used else {f for f in held if f[0] is None or f[0] not in s["defs"]}
        if s["ends"]:
            held = {f for f in held if f[0] is None or f[0] not in s["defs"]}
    return held


def _solved(seeds: list[dict], arcs: list[dict] | None, bodies: list[dict] | None) -> dict:
    """block -> facts at its end: blocks that new facts reach are moved through again until none are new."""
    before, onward = defaultdict(list), defaultdict(list)
    for arc in arcs or ():
        if arc["src"] is not None and arc["dst"] is not None:
            before[arc["dst"]].append(arc["src"])
            onward[arc["src"]].append(arc["dst"])
    own, behind = {b["block"]: b["body"] for b in bodies or ()}, defaultdict(set)
    for f in seeds:
        behind[f["block"]].add((f["var"], f["line"], f["source"]))
    waiting = dict.fromkeys(to for block in behind for to in onward.get(block, ()))
    while waiting:
        block = next(iter(waiting))
        del waiting[block]
        new = _passed({f for b in before[block] for f in behind.get(b, ())}, own.get(block, ())) - behind.get(block, set())
        if new:
            behind[block] |= new
            waiting |= dict.fromkeys(onward.get(block, ()))
    return behind


def blocks_of(statements: DataFrame) -> DataFrame:
    """func, block, body: each block's statements in the order of pos, as far as they move taint."""
    defs, uses = (F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("defs", "uses"))
    assigns = (F.col("kind").isin(*ASSIGNS) & (F.size(defs) > 0)).alias("assigns")
    ends = (F.col("kind").isin(*CLEANS) & F.coalesce("cleans", F.lit(False))).alias("ends")
    told = statements.select("func", "block", F.struct("pos", defs, uses, assigns, ends).alias("s")).filter("s.assigns or s.ends")
    return told.groupBy("func", "block").agg(F.sort_array(F.collect_list("s")).alias("body"))


def seeds(statements: DataFrame) -> DataFrame:
    """func, block, var, line, source: what statements bring in; where nothing is assigned, under a name of the line's own."""
    told = statements.filter(F.col("kind").isin(*SEEDS) & F.col("source").isNotNull())
    alone = F.array(F.concat(F.lit("__ret_"), F.col("line")))
    names = F.when(F.size(F.coalesce("defs", F.array().cast("array<string>"))) > 0, F.col("defs")).otherwise(alone)
    return told.select("func", "block", F.explode(names).alias("var"), F.col("line").cast("long").alias("line"), "source").distinct()


def held_behind(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """func, block, var, line, source: which variables are tainted at each block's end, by which sources.

    statements: func, block, pos, line, kind, defs, uses, source, cleans; edges: func, src, dst (blocks). The least
    fixpoint: a block's facts are those behind its predecessors, moved through its statements; what it brings in itself
    holds from its end on. A function's blocks, edges and seeds meet in one row and are solved there, as no two functions
    meet: no rounds over all of them, whose plans the driver would hold. A function must fit a task.
    """
    brought = seeds(statements)
    kinds = dict(brought.dtypes)
    one = brought.groupBy("func").agg(F.collect_list(F.struct("block", "var", "line", "source")).alias("seeds"))
    arcs = edges.select("func", "src", "dst").distinct().groupBy("func").agg(F.collect_list(F.struct("src", "dst")).alias("arcs"))
    bodies = blocks_of(statements).groupBy("func").agg(F.collect_list(F.struct("block", "body")).alias("bodies"))
    columns = ["func", "block", "var", "line", "source"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("func").type, *(batch.schema.field("seeds").type.value_type.field(c).type for c in columns[1:])]
            for start in range(0, batch.num_rows, SLICE):
                told = []
                for row in batch.slice(start, SLICE).to_pylist():
                    told += [(row["func"], block, *f) for block, facts in _solved(row["seeds"], row["arcs"], row["bodies"]).items() for f in facts]
                yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate(types)], names=columns)

    whole = joined(joined(one, arcs, ["func"], "left"), bodies, ["func"], "left")
    return whole.mapInArrow(solved, ", ".join(f"{c} {kinds[c]}" for c in columns))


def tainted_sinks(statements: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, line, sink, var, source_line, source, sanitised: sinks whose arguments are tainted at their block's end.

    statements as in held_behind(), with sink (null: none) and args (names); entries: func, node. A finding is sanitised
    where a block with a sanitiser's call that assigns the variable dominates the sink's block; it is kept, so that a
    reader can rank it lower. Blocks that no entry reaches are dominated by nothing.
    """
    facts = held_behind(statements, edges)
    sinks = statements.filter("sink is not null").select("func", "block", F.col("line").alias("at"), "sink", F.explode("args").alias("var"))
    found = joined(sinks, facts, ["func", "block", "var"]).distinct()
    guards = statements.filter("cleans").select("func", F.col("block").alias("dom"), F.explode("defs").alias("var")).distinct()
    over = flow.dominators(edges, entries).withColumnRenamed("node", "block")
    safe = joined(guards, over, ["func", "dom"]).select("func", "block", "var").distinct().withColumn("safe", F.lit(True))
    return joined(found, safe, ["func", "block", "var"], "left").select(
        "func", F.col("at").alias("line"), "sink", "var", F.col("line").alias("source_line"), "source", F.coalesce("safe", F.lit(False)).alias("sanitised")
    )


def argument_tokens(calls: DataFrame) -> DataFrame:
    """unit, func, line, callee, position, token: the words of each argument of each call (args: texts), each once."""
    args = calls.select("unit", "func", "line", "callee", F.posexplode("args").alias("position", "arg"))
    words = F.array_distinct(F.regexp_extract_all("arg", F.lit(r"(\w+)"), F.lit(1)))
    return args.select("unit", "func", "line", "callee", "position", F.explode(words).alias("token"))


def tainted_names(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """unit, func, var: local names and parameters that hold data from outside, through all calls of a unit.

    functions: unit, func, params (names); calls: unit, func, line, callee, args (texts). Names given to a source's call
    are tainted, and the main functions' parameters from outside; a function's parameter is, if any word of the argument
    at its position is in any caller. A join of each round's new facts with the words of arguments, by equal names.
    """
    plain = F.regexp_extract(F.regexp_replace(F.trim("arg"), "^&+", ""), r"^(\w+)$", 1)
    given = calls.filter(F.col("callee").isin(*SOURCES)).select("unit", "func", F.explode("args").alias("arg")).select("unit", "func", plain.alias("var"))
    own = functions.filter(F.col("func").isin(*MAINS)).select("unit", "func", F.explode("params").alias("var")).filter(F.col("var").isin(*FROM_OUTSIDE))
    known = functions.select("unit", F.col("func").alias("callee"), F.posexplode("params").alias("position", "param"))
    passed = joined(argument_tokens(calls), known, ["unit", "callee", "position"])
    passed = passed.select("unit", F.col("func").alias("__from"), F.col("token").alias("__var"), "callee", "param").distinct().checkpoint()

    def step(facts: DataFrame) -> DataFrame:
        met = joined(facts.select("unit", F.col("func").alias("__from"), F.col("var").alias("__var")), passed, ["unit", "__from", "__var"])
        return met.select("unit", F.col("callee").alias("func"), F.col("param").alias("var"))

    return flow.fixpoint(given.filter("var <> ''").union(own), step)


def sink_violations(functions: DataFrame, calls: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """unit, issue, line, func: calls of sinks with a tainted name in an argument, once for each issue and line of a unit.

    names: tainted_names() of the same functions and calls, made here if none are given.
    """
    names = tainted_names(functions, calls) if names is None else names
    issue = F.create_map(*(F.lit(x) for pair in SINKS.items() for x in pair))[F.col("callee")]
    given = argument_tokens(calls.filter(F.col("callee").isin(*SINKS))).select("unit", "func", "line", issue.alias("issue"), F.col("token").alias("var"))
    return joined(given, names, ["unit", "func", "var"], "left_semi").groupBy("unit", "issue", "line").agg(F.min("func").alias("func"))


def summaries(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """unit, func, position, issue: which parameters of a function reach a sink's call, directly or through calls."""
    params = functions.select("unit", "func", F.posexplode("params").alias("position", "token"))
    uses = joined(argument_tokens(calls).withColumnRenamed("position", "given"), params, ["unit", "func", "token"])
    issue = F.create_map(*(F.lit(x) for pair in SINKS.items() for x in pair))[F.col("callee")]
    direct = uses.filter(F.col("callee").isin(*SINKS)).select("unit", "func", "position", issue.alias("issue"))
    passed = uses.select("unit", "func", "position", F.col("callee").alias("__callee"), F.col("given").alias("__given")).distinct().checkpoint()

    def step(facts: DataFrame) -> DataFrame:
        met = facts.select("unit", F.col("func").alias("__callee"), F.col("position").alias("__given"), "issue")
        return joined(met, passed, ["unit", "__callee", "__given"]).select("unit", "func", "position", "issue")

    return flow.fixpoint(direct, step)


# Words of a size that are no names (fixed values).
KEYWORDS = ["sizeof", "static_cast", "size_t", "uint64_t", "uint32_t", "uint16_t", "uint8_t", "int", "long", "unsigned", "reinterpret_cast"]


def identifiers(text: Column, skipped: list[str] = KEYWORDS) -> Column:
    """The names in a text, in order, repeated ones too, without the skipped words."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?<!\w)([a-zA-Z_]\w*)"), F.lit(1)), lambda n: ~n.isin(*skipped))


def first_tainted_arguments(sinks: DataFrame, names: DataFrame) -> DataFrame:
    """unit, issue, line, place, var, rank: for each issue and line of a unit the first sink with a tainted name, and its first name.

    sinks: unit, issue, line, place (their order), args (a text); names: unit, var, rank (their order). The words of
    arguments, each once, meet the names by equality, so no pattern is made of a name; ties of rank go to the smaller
    name. Null arguments, names and units meet nothing.
    """
    words = sinks.select("unit", "issue", "line", "place", F.explode(F.array_distinct(F.regexp_extract_all("args", F.lit(r"(\w+)"), F.lit(1)))).alias("var"))
    met = words.join(names.groupBy("unit", "var").agg(F.min("rank").alias("rank")), ["unit", "var"])
    return met.groupBy("unit", "issue", "line").agg(F.min(F.struct("place", "rank", "var")).alias("f")).select("unit", "issue", "line", "f.*")
