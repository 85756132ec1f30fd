"""Races and misused locks of four languages: places of a pattern, and what stands or is missing around them.

A file is one row. A rule's places are found once, with their offsets; guards are looked for in a span of characters
before and after each place, and names are met as sets (all names written or waited on), not by a pattern for each name.
Nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.scan import _breaks, language, plain, stripped

#: Languages by extension (fixed values).
KNOWN = {".c": "c", ".cpp": "c", ".cc": "c", ".cxx": "c", ".h": "c", ".hpp": "c", ".java": "java", ".go": "go", ".py": "python"}
#: Strings stay, comments are blanked out: of the C family, and of Python.
BRACED = r"""(?s:".*?"|'.*?'|/\*.*?\*/)|//[^\n]*"""
HASHED = r"""(?s:".*?"|'.*?')|#[^\n]*"""
#: Names in the order in which they are declared or called, and what happens to them (fixed values).
DECLARED = r"\b(?:volatile\s+)?(?:int|long|char|double|float|uint\d+_t)\s+(\w+)\s*="
WRITTEN = r"\b(\w+)\s*(?:\+\+|--|[+\-*/|&^]?=)"
COUNTED = r"(?i)(?:static\s+|extern\s+)?(?:int|long|unsigned)\s+(\w*(?:count|total)\w*)\s*=\s*0\s*;"
STEPPED = r"\b(\w+)\s*(?:\+\+|--|\+=|-=)"
FLAGGED = r"\bvolatile\s+(?:int|long|bool)\s+(\w+)"
AWAITED = r"while\s*\(\s*!?\s*(\w+)\s*\)"
C_TWICE = r"if\s*\(\s*(\w+)\s*==\s*(?:nullptr|NULL|0)\s*\)\s*\{[^}]*(?:lock|mutex)[^}]*\1\s*=[^}]*if\s*\(\s*\1\s*==\s*(?:nullptr|NULL|0)\s*\)"
JAVA_TWICE = r"if\s*\(\s*(\w+)\s*==\s*null\s*\)\s*\{[^}]*synchronized[^}]*if\s*\(\s*\1\s*==\s*null\s*\)"
LOOPED = r"for\s+(?:\w+\s*,\s*)?(\w+)\s*:=\s*range\s+\w+[^{]*\{[^}]*go\s+func\s*\("
CHANGED = r"\.append\(|\.extend\(|\.update\(|\[[^\n]*?\]\s*="
COROUTINE = r"\b(\w+_async|async_\w+|aio\w+)\s*\("

#: Places that are gathered at a time.
BLOCK = 128
_PLACES = "array<struct<at:int,end:int,line:int,held:string>>"
_HITS = "array<struct<issue:string,line:int,first:int,at:int,name:string,confidence:string>>"


def places(text: Column, pattern: str | Column, group: int | Column = 0) -> Column:
    """Every match in order: array of (at, end, line, held), offsets from 0 in code points, end exclusive, line from 1."""
    pattern, group = (x if isinstance(x, Column) else F.lit(x) for x in (pattern, group))
    whole, told = (F.regexp_extract_all(text, pattern, k) for k in (F.lit(0), group))
    steps = F.arrays_zip(F.split(text, pattern).alias("b"), whole.alias("m"), told.alias("t"))
    none = F.array().cast(_PLACES)
    reached = lambda at, line, out: F.struct(at.alias("at"), line.alias("line"), out.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at, line = acc["at"] + F.length(s["b"]), acc["line"] + _breaks(s["b"])
        end = at + F.coalesce(F.length(s["m"]), F.lit(0))
        found = F.array(F.struct(at.alias("at"), end.alias("end"), line.alias("line"), s["t"].alias("held"))).cast(_PLACES)
        return reached(end, line + F.coalesce(_breaks(s["m"]), F.lit(0)), F.when(s["t"].isNotNull(), F.concat(acc["out"], found)).otherwise(acc["out"]))

    def block(acc: Column, part: Column) -> Column:
        """A block's places are gathered by themselves, so that adding one copies a block at most."""
        told = F.array(F.aggregate(part, reached(acc["at"], acc["line"], none), step))
        return F.element_at(F.transform(told, lambda b: reached(b["at"], b["line"], F.concat(acc["out"], F.array(b["out"])))), 1)

    def walked(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda k: F.slice(every, k * BLOCK + 1, BLOCK))
        start = reached(F.lit(0), F.lit(1), F.array().cast(f"array<{_PLACES}>"))
        return F.aggregate(parts, start, block, lambda acc: F.flatten(acc["out"]))

    # an array of one binds the pieces, which are used several times
    return F.when(F.regexp_like(text, pattern), F.flatten(F.transform(F.array(steps), walked))).otherwise(none)


def blanked(text: Column, pattern: str) -> Column:
    """The text with the pattern's matches as spaces, but those in quotes and all line breaks: places don't move."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.when(p.rlike("^[\"']"), p).otherwise(F.regexp_replace(p, r"[^\n]", " ")))
    return F.concat_ws("", F.flatten(F.zip_with(F.split(text, pattern), parts, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


class _Asked:
    """The patterns that a language's rules ask for. Their places are found by one expression over the list, in a column
    of their own, so that the plan doesn't hold that expression for each pattern."""

    def __init__(self):
        self.patterns: list[Column] = []

    def __call__(self, pattern: str, group: int = 0) -> Column:
        self.patterns.append(F.struct(F.lit(pattern).alias("pattern"), F.lit(group).alias("group")))
        return F.get(F.col("places"), len(self.patterns) - 1)


def _span(text: Column, start: Column, end: Column) -> Column:
    low = F.greatest(start, F.lit(0))
    return F.substr(text, low + 1, F.greatest(end - low, F.lit(0)))


def _has(text: Column, *words: str) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def _hits(found: Column, issue: str, confidence: str, named: bool | Column = False, first=None) -> Column:
    """Findings of an issue at places. first: what is smaller of two on one line comes first, before their offsets."""

    def hit(p: Column) -> Column:
        name = named(p) if callable(named) else p["held"] if named else F.lit(None).cast("string")
        return F.struct(
            F.lit(issue).alias("issue"), p["line"].alias("line"), (first(p) if first else F.lit(0)).cast("int").alias("first"), p["at"].alias("at"), name.alias("name"), F.lit(confidence).alias("confidence")
        )

    return F.transform(found, hit).cast(_HITS)


def _c(t: Column, line, places) -> list[Column]:
    threads = t.rlike("pthread|std::thread|std::mutex|std::atomic|_beginthread")
    none = F.array().cast(_HITS)
    bare = F.filter(places(r"\bpthread_create\s*\("), lambda p: ~_has(_span(t, p["at"] - 1500, p["end"] + 1500), "pthread_mutex_lock", "std::mutex"))
    # not indented, and no comment's or directive's line
    globals_ = F.transform(F.filter(places(DECLARED, 1), lambda p: ~line(p).rlike(r"^(?:[ \t]|\s*(?:/[/*]|[#*]))")), lambda p: p["held"])

    def written(names: Column) -> Column:
        loose = lambda p: ~_has(_span(t, p["at"] - 1500, p["at"]), "pthread_mutex_lock") & ~_has(_span(t, p["at"] - 500, p["at"]), "atomic")
        found = F.filter(places(WRITTEN, 1), lambda p: F.array_contains(names, p["held"]) & line(p).rlike("^(?:    |\t)") & loose(p))
        return _hits(found, "data-race", "LOW", True, lambda p: F.array_position(names, p["held"]))

    races = F.flatten(F.transform(F.filter(F.array(globals_), lambda n: F.size(n) > 0), written))
    stepped = F.regexp_extract_all(t, F.lit(STEPPED), F.lit(1))
    counters = F.filter(places(COUNTED, 1), lambda p: ~line(p).rlike("^[ \t]") & F.array_contains(stepped, p["held"]))
    flags = F.filter(places(FLAGGED, 1), lambda p: F.array_contains(F.regexp_extract_all(t, F.lit(AWAITED), F.lit(1)), p["held"]))
    return [
        _hits(bare, "race-condition", "MEDIUM"),
        F.when(threads, races).otherwise(none),
        _hits(flags, "volatile-misuse", "HIGH", True),
        F.when(threads, _hits(counters, "missing-atomic", "MEDIUM", True)).otherwise(none),
        _hits(places(C_TWICE, 1), "double-checked-locking", "HIGH", True),
        _hits(places(r"~\s*\w+\s*\([^)]*\)\s*\{[^}]*pthread_create"), "thread-in-destructor", "HIGH"),
    ]


def _java(t: Column, line, places) -> list[Column]:
    classes = places(r"class\s+\w+\s+extends\s+Thread\s*\{((?s:.*?))(?=\nclass|\z)", 1)
    loose = F.filter(classes, lambda p: ~_has(p["held"], "synchronized", "volatile") & p["held"].rlike(r"(?:private|protected|public)\s+(?:int|long|boolean|String)\s+\w+"))
    walked = F.filter(
        places(r"Collections\.synchronized(?:List|Map|Set)\s*\("),
        lambda p: _span(t, p["end"], p["end"] + 3000).rlike(r"\.iterator\(\)|for\s*\([^\n]*?:") & ~_has(_span(t, p["end"], p["end"] + 500), "synchronized"),
    )
    twice = F.filter(places(JAVA_TWICE, 1), lambda p: ~_has(_span(t, p["at"] - 500, p["at"]), "volatile"))
    maps = F.filter(places(r"new\s+HashMap\s*<"), lambda p: ~line(p).rlike(r"^\s*(?://|\*)") & _has(t, "new Thread", "implements Runnable"))
    waits = F.filter(places(r"\.\s*(?:wait|notify|notifyAll)\s*\("), lambda p: ~_has(_span(t, p["at"] - 500, p["at"]), "synchronized"))
    return [
        _hits(loose, "unsynchronized-thread", "MEDIUM", lambda p: F.regexp_extract(_span(t, p["at"], p["end"]), r"^class\s+(\w+)", 1)),
        _hits(walked, "unsafe-iteration", "HIGH"),
        _hits(twice, "double-checked-locking", "HIGH", True),
        _hits(maps, "unsynchronized-hashmap", "LOW"),
        _hits(waits, "wait-outside-sync", "HIGH"),
    ]


def _go(t: Column, line, places) -> list[Column]:
    held = F.filter(places(LOOPED, 1), lambda p: ~_span(t, p["at"], p["end"] + 300).contains(F.concat(F.lit("("), p["held"], F.lit(")"))))
    maps = F.filter(
        places(r"\bmap\["),
        lambda p: _span(t, p["end"], p["end"] + 2000).rlike(r"\bgo\s+func") & ~_has(_span(t, p["at"] - 200, p["at"] + 200), "sync.Mutex", "sync.RWMutex"),
    )
    sends = F.filter(
        places(r"\bch\s*<-\s*|<-\s*\bch\b"),
        lambda p: ~_has(_span(t, p["at"] - 200, p["at"] + 200), "select", "time.After") & _has(_span(t, p["at"] - 1000, p["at"]), "go func", "func("),
    )
    return [
        _hits(held, "goroutine-loop-closure", "HIGH", True),
        F.when(t.contains("go "), _hits(maps, "concurrent-map-write", "MEDIUM")).otherwise(F.array().cast(_HITS)),
        _hits(places(r"go\s+func\s*\([^)]*\)\s*\{[^}]*\.Add\s*\("), "waitgroup-add-in-goroutine", "HIGH"),
        _hits(sends, "unbuffered-channel-block", "LOW"),
    ]


def _python(t: Column, line, places) -> list[Column]:
    threads = ("threading.Thread", "Thread(target=")

    def loose(p: Column) -> Column:
        before = _span(t, p["at"] - 1000, p["at"])
        return _has(before, *threads) & ~_has(before, "threading.Lock", "with lock")

    none = F.array().cast(_HITS)

    def called(ends: Column) -> Column:
        """Calls in the 2000 characters after a coroutine's head, on lines that neither await nor hold a hash."""
        over = lambda p: F.filter(ends, lambda e: (p["at"] >= e) & (p["end"] <= e + 2000))
        found = F.filter(places(COROUTINE, 1), lambda p: (F.size(over(p)) > 0) & ~_has(line(p), "await", "#"))
        return _hits(found, "missing-await", "HIGH", True, lambda p: F.get(over(p), 0))

    heads = F.transform(places(r"\basync\s+def\s+\w+"), lambda p: p["end"])
    calls = F.flatten(F.transform(F.filter(F.array(heads), lambda e: F.size(e) > 0), called))
    alone = F.filter(places(r"multiprocessing\.Process\s*\("), lambda p: ~_has(_span(t, p["at"] - 500, p["at"] + 500), "Manager()", "multiprocessing.Lock"))
    return [
        F.when(_has(t, *threads), _hits(F.filter(places(CHANGED), loose), "thread-unsafe-mutation", "MEDIUM")).otherwise(none),
        # a head apart by other white space counts only where asyncio is named
        F.when(_has(t, "async def", "asyncio"), calls).otherwise(none),
        _hits(alone, "multiprocess-unshared", "LOW"),
        _hits(F.filter(places(r"Thread\s*\([^)]*\)"), lambda p: ~p["held"].contains("daemon")), "non-daemon-thread", "LOW"),
    ]


def concurrency(files: DataFrame) -> DataFrame:
    """path, lang, line, issue, confidence, name, snippet of races and misused locks in files (path, content).

    Of an issue on a line the first finding stays: by the declaration of its name or the head of its coroutine, then by
    place. Null and empty contents and files of other languages have none; rows of one path are files of their own.
    """
    rows = files.select("path", language(F.col("path"), KNOWN).alias("lang"), plain(F.col("content")).alias("raw")).filter("lang is not null and raw <> ''")
    rows = rows.withColumn("text", F.when(F.col("lang") == "python", blanked(F.col("raw"), HASHED)).otherwise(blanked(F.col("raw"), BRACED)))
    rows = rows.withColumn("lines", F.split("raw", "\n"))
    line = lambda p: F.get(F.col("lines"), p["line"] - 1)
    found, asked = F.lit(None), F.lit(None)
    for lang, rules in (("c", _c), ("java", _java), ("go", _go), ("python", _python)):
        patterns = _Asked()
        found = F.when(F.col("lang") == lang, F.concat(*rules(F.col("text"), line, patterns))).otherwise(found)
        asked = F.when(F.col("lang") == lang, F.array(*patterns.patterns)).otherwise(asked)
    rows = rows.withColumn("places", F.transform(asked, lambda r: places(F.col("text"), r["pattern"], r["group"])))

    def shown(hits: Column) -> Column:
        same = lambda h, p: (p["issue"] == h["issue"]) & (p["line"] == h["line"])
        once = F.filter(hits, lambda h, i: (i == 0) | ~same(h, F.get(hits, i - 1)))
        return F.transform(once, lambda h: F.struct(*(h[n].alias(n) for n in ("line", "issue", "confidence", "name")), stripped(line(h)).alias("snippet")))

    told = F.flatten(F.transform(F.array(F.array_sort(found)), shown))
    # outer, so that no filter on the array's size is made of it and pushed down, which would find all hits twice
    return rows.select("path", "lang", F.explode_outer(told).alias("h")).filter("h is not null").select("path", "lang", "h.*")
