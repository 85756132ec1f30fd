"""URL filtering by explicit host/path rules, and association rules mined by FP-growth for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import sqrt

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, stash

#: The explicit rules (fixed values): verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BLOCK, ALLOW = "=block", "=allow"
#: A combination is mined from this share of the URLs on, and from so many URLs at least.
SUPPORT, LEAST_URLS = 0.005, 20
CONFIDENCE = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)
_PARTS = re.compile(r"(?s)(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#)?")
_DIGITS = re.compile(r"[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two of a URL column; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule that fits, of equally long ones the last by code point;
    null where none fits. A rule fits its host and all subdomains, if the path starts with the rule's."""
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    told = [F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, order, strict=True)]
    said = [F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, order, strict=True)]
    nothing = F.lit(None).cast("string")
    return F.coalesce(*told, nothing), F.coalesce(*said, nothing)


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of the whole URL: scheme, every host label, every path segment, every query parameter by name
    and with its value, and whether there is a fragment; a part with digits comes as it is and with each run of digits
    as 0. ASCII letters are lower-cased. A URL without `://` has none."""
    found = _PARTS.match(url or "")
    if not found:
        return []
    scheme, host, path, query, fragment = (x.translate(_ASCII_LOWER) if x else "" for x in found.groups())
    parts = ["s:" + scheme, *("h:" + x for x in host.split(".") if x), *("p:" + x for x in path.split("/") if x)]
    for pair in filter(None, query.split("&")):
        parts += ["q:" + pair.partition("=")[0], "v:" + pair]
    parts += ["f:"] * bool(fragment)
    return list(dict.fromkeys(t for p in parts for t in (p, _DIGITS.sub("0", p))))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [tokens(u) for u in batch.column(0).to_pylist()]
        held = [k for k, t in enumerate(own) if t]
        yield pa.RecordBatch.from_arrays(
            [pa.array([own[k] for k in held], pa.list_(pa.string())), batch.column(1).take(pa.array(held, pa.int64()))],
            names=["tokens", "bad"],
        )


def surely_above(confidence: float, n: float, base: float) -> bool:
    """Whether a share of n is above the base rate beyond chance (lower bound of Wilson's interval at 95 %)."""
    z = 1.96
    low = (confidence + z * z / (2 * n) - z * sqrt(confidence * (1 - confidence) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return low > base


def mine(
    pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_URLS,
    label: str | None = None,
) -> list[frozenset[str]]:
    """Token combinations that mean `block`, mined by FP-growth from all URLs.

    A page is bad where the column `label` says so (true or a number over 0; null counts as no); without one, where an
    explicit rule blocks it. Kept are rules of the support (as a share, and `least` URLs) and confidence that are surely
    above the share of bad pages, and that contain no smaller one of them. Tokens that too few bad URLs have cannot be
    part of one and are left out before mining, which no longer depends on how long a URL is; of tokens that stand in
    the very same URLs the first by code point stands for all, so that a long URL repeated often is no long pattern.
    What is left is at most (tokens of a URL) / support tokens, and comes to the driver, as do the rules.
    """
    if label is None:
        said = explicit(*host_and_path(F.col("url")))[1]
        bad = F.coalesce(said == "block", F.lit(False))
    else:
        bad = F.coalesce(F.col(label).cast("double") > 0, F.lit(False))
    marked = pages.select("url", bad.alias("bad")).mapInArrow(_cut, "tokens array<string>, bad boolean")
    marked = stash(marked.withColumn("row", F.monotonically_increasing_id()))
    n, n_bad = marked.agg(F.count("*"), F.count_if("bad")).first()
    floor = max(least, support * n)
    if n_bad < floor:
        discard(marked)
        return []
    places = F.struct(F.bit_xor(F.xxhash64("row")), F.sum(F.xxhash64("row").cast("decimal(20,0)"))).alias("places")
    held = marked.select("row", "bad", F.explode("tokens").alias("t")).groupBy("t")
    held = held.agg(F.count_if("bad").alias("k"), F.count("*").alias("c"), places).filter(F.col("k") >= floor)
    keep = {r[0] for r in held.groupBy("c", "places").agg(F.min("t")).select("min(t)").collect()}
    if not keep:
        discard(marked)
        return []
    spoken = F.filter("tokens", lambda t: t.isin(*keep))
    items = stash(marked.select(F.concat(spoken, F.array(F.when(F.col("bad"), BLOCK).otherwise(ALLOW))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=floor / n, minConfidence=confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0] == BLOCK)
    found = rules.filter((F.col("support") * n >= floor - 0.5) & (F.col("confidence") >= confidence))
    found = found.select("antecedent", "confidence", "support").collect()
    discard(marked)
    discard(items)
    kept: list[frozenset[str]] = []
    for rule, sure, share in sorted(((frozenset(a), c, s) for a, c, s in found), key=lambda x: (len(x[0]), sorted(x[0]))):
        clear = ALLOW not in rule and surely_above(sure, share * n / sure, n_bad / n)
        if clear and not any(smaller <= rule for smaller in kept):
            kept.append(rule)
    return kept


def inverted(rules: Iterable[frozenset[str]]) -> dict[str, list[frozenset[str]]]:
    """Each rule under its token that the fewest rules share: a URL looks up its tokens and checks what they list."""
    rules = list(rules)
    spread: dict[str, int] = {}
    for rule in rules:
        for t in rule:
            spread[t] = spread.get(t, 0) + 1
    index: dict[str, list[frozenset[str]]] = {}
    for rule in rules:
        index.setdefault(min(rule, key=lambda t: (spread[t], t)), []).append(rule)
    return index


def judge(url: str | None, index: dict[str, list[frozenset[str]]]) -> str:
    own = tokens(url)
    have = set(own)
    return "block" if any(rule <= have for t in own for rule in index.get(t, ())) else "allow"


def filter_urls(
    pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_URLS,
    label: str | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, method_verdict for each row of pages.

    The explicit rule's verdict holds where one fits (the longest wins, on host and all its subdomains); else the
    mined rules': block if one of them is contained in the URL's tokens. Without enough bad URLs nothing is mined and
    the method allows. Null URLs and those without `://` have empty host and path, no tokens and are allowed; repeated
    rows are judged alike, and rows with one id or a null one each by itself; of rules of one length at most one fits a
    URL here, and in general the last by code point wins; an empty table gives an empty result; a very long URL has all
    its tokens; further columns are ignored, whatever their names.
    """
    index = inverted(mine(pages, support, confidence, least, label))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([judge(u, index) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], names=["page_id", "url", "method_verdict"])

    kind = dict(pages.dtypes)["page_id"]
    told = pages.select("page_id", "url").mapInArrow(judged, f"page_id {kind}, url string, method_verdict string")
    host, path = host_and_path(F.col("url"))
    told = told.select("page_id", host.alias("host"), path.alias("path"), "method_verdict")
    rule, said = explicit(F.col("host"), F.col("path"))
    verdict = F.coalesce(said, F.col("method_verdict"))
    return told.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "method_verdict")
