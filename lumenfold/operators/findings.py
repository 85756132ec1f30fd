"""Findings: rule matches on lines, first-wins dedup, enrichment by small tables, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import rank
from lumenfold.operators.scan import stripped


def match_rules(rows: DataFrame, rules: list[tuple], once: list[str] | None = None) -> DataFrame:
    """(path, line, text) against (rule_ord, stage_ord, stage, issue, severity, cwe, pattern, gate), in one scan.

    The rules become literals: one narrow array of the rules that match a line, exploded. No join, no shuffle. gate is a
    text that every match holds, or empty: it is looked for first, so that a pattern that backtracks meets few lines.
    once: columns whose first hit on a line wins, in order of the rules' list; as all hits of a line come from one row,
    that happens within the array, before anything is exploded.
    """
    hits = []
    for rule_ord, stage_ord, stage, issue, sev, cwe, pattern, gate in rules:
        told = F.struct(
            F.lit(rule_ord).alias("rule_ord"), F.lit(stage_ord).alias("stage_ord"), F.lit(stage).alias("stage"),
            F.lit(issue).alias("issue"), F.lit(sev).alias("severity"), F.lit(cwe).alias("cwe"),
        )
        met = F.col("text").rlike(pattern)
        hits.append(F.when(F.col("text").contains(gate) & met if gate else met, told))
    some = F.filter(F.array(*hits), lambda x: x.isNotNull())
    found = rows.select("path", "line", some.alias("hits"), "text")
    if once:
        key = lambda h: F.concat_ws("\x00", *[h[c] for c in once])
        first = F.filter("hits", lambda h, i: F.array_position(F.transform(F.col("hits"), key), key(h)) == i + 1)
        found = found.withColumn("hits", first)
    # outer, so that no filter on the array's size is made of it and pushed down, which would match all rules twice
    out = found.select("path", "line", F.explode_outer("hits").alias("hit"), "text").filter("hit is not null")
    return out.select("path", "line", "hit.*", stripped(F.col("text")).alias("snippet")).withColumn("sev_rank", rank(F.col("severity")))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_dimension(rows: DataFrame, dim: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with a small table; columns that miss get their default."""
    out = rows.join(dim, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def category(rows: DataFrame, by_cwe: dict[str, str], by_word: list[tuple[str, str]]) -> DataFrame:
    """category by weakness id; else by the first word of the ordered list that the issue contains; else empty."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in by_cwe.items() for x in kv]), F.col("cwe"))
    words = F.coalesce(*[F.when(F.col("issue").contains(w), F.lit(c)) for w, c in by_word], F.lit(""))
    return rows.withColumn("category", F.coalesce(named, words))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count of each key, and its share of all in per cent, to one digit."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def worst(files: DataFrame, rows: DataFrame) -> DataFrame:
    """The worst severity of each file; SECURE where there is none above INFO."""
    bad = rows.filter("sev_rank >= 1").groupBy("path").agg(F.max_by("severity", "sev_rank").alias("worst"))
    return files.select("path").join(bad, "path", "left").select("path", F.coalesce("worst", F.lit("SECURE")).alias("worst"))


def pivoted(rows: DataFrame) -> DataFrame:
    """A row for each file with a count for each severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]
    return rows.groupBy("path").agg(*counts, F.count(F.lit(1)).alias("total"))


def firsts(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def confusion(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """The rows of both with kind tp, fp (pred alone) or fn (truth alone); rows count once, nulls equal nulls."""
    both = truth.intersect(pred).withColumn("kind", F.lit("tp"))
    extra = pred.subtract(truth).withColumn("kind", F.lit("fp"))
    return both.union(extra).union(truth.subtract(pred).withColumn("kind", F.lit("fn")))


def at_least(rows: DataFrame, least: int, left_out: list[str] = [], only: list[str] = []) -> DataFrame:  # noqa: B006
    """Findings from a rank on, without the issues left out and, if any are named, only those."""
    out = rows.filter(F.col("sev_rank") >= least)
    out = out.filter(~F.col("issue").isin(*left_out)) if left_out else out
    return out.filter(F.col("issue").isin(*only)) if only else out


def fails(rows: DataFrame, least: int) -> DataFrame:
    """path, fails: whether a file has a finding of the rank or a worse one."""
    return rows.groupBy("path").agg(F.bool_or(F.col("sev_rank") >= least).alias("fails"))


def lacking(files: DataFrame, rows: DataFrame, issue: str) -> DataFrame:
    """path of files without a finding of the issue."""
    has = rows.filter(F.col("issue") == issue).select("path").distinct()
    return files.select("path").join(has, "path", "left_anti")


def accuracy(rows: DataFrame, suite: str) -> DataFrame:
    """Precision, recall and F1 for each suite and over all (suite null), from truth and pred (0 or 1)."""
    tp, fp = F.count_if(F.expr("truth = 1 and pred = 1")), F.count_if(F.expr("truth = 0 and pred = 1"))
    fn = F.count_if(F.expr("truth = 1 and pred = 0"))
    out = rows.withColumns({"truth": F.col("truth"), "pred": F.col("pred")}).rollup(suite)
    out = out.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(suite, "tp", "fp", "fn", ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"))
