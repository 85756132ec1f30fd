"""Races against plain loops over each file, on random files with strings, comments and guards near and far."""

import random
import re

import pytest

from lumenfold.operators import concurrency as cc

FAR = ["." * n for n in (3, 190, 480, 700, 1400)]
PIECES = {
    ".c": ["int total = 0;", "static long counter = 0 ;", "int a=1, b;", "    total++;", "\ttotal += 2;", "    a = 3; total = 4;", "  a = 5;", "    counter == 1", "pthread_create (x)", "pthread_mutex_lock(&m)", "std::mutex m;", "atomic",
           "volatile bool stop;", "while ( !stop )", '"// not a comment" // pthread', "/* std::mutex\n */ int c = 2;", "if (p == NULL) { lock; p = 1; if (p == 0)", "~A() { pthread_create", "#int d = 1", "    d--; é", "'"],
    ".java": ["class A extends Thread {", "private int x;", "synchronized", "volatile", "Collections.synchronizedMap (", "x.iterator()", "for (int x : y)", "for (x;", ": z", "if (q == null) { synchronized (a) { if (q == null)", "new HashMap<A>", "* new HashMap <A>",
              "new Thread(", "implements Runnable", "x.wait()", "y . notifyAll ()", "// synchronized", "/* volatile\n*/", '"synchronized"', "class B"],
    ".go": ["for _, v := range xs { go func() { use(v, 1)", "for v := range xs {\n go func(w) {", "(v)", "map[string]int", "sync.Mutex", "// sync.RWMutex", "go func(x int) { wg.Add(1) }", "go func() {", "}", "ch <- 1", "<-ch", "select", "time.After", "f := func(", "go x()"],
    ".py": ["threading.Thread(target=f)", "Thread(target=f, daemon=True)", "Thread (\n)", "threading.Lock()", "with lock", "x.append(1)", "d[1] = 2", "d[1] [2]=3", "async def go", "async  def async_go (x)", "load_async(1)", "await load_async(1)", "aiofiles(2) # x", "aiofiles (3); my_async()",
            "multiprocessing.Process(", "Manager()", "multiprocessing.Lock", '"# Thread()"', "# Thread()", "asyncio", "'"],
}


def brute(path: str, raw: str) -> set[tuple]:
    """The rules one by one, names by a pattern of their own."""
    raw = re.sub("\r\n?", "\n", raw)
    ext = "." + path.rsplit(".", 1)[-1].lower()
    lines = raw.split("\n")
    out, at = [], 0
    for m in re.finditer(r"""(?s:".*?"|'.*?')|#[^\n]*""" if ext == ".py" else r"""(?s:".*?"|'.*?'|/\*.*?\*/)|//[^\n]*""", raw):
        out += [raw[at : m.start()], m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0])]
        at = m.end()
    t = "".join(out) + raw[at:]
    told: dict[tuple, tuple] = {}
    find = lambda p, flags=0: re.finditer(p, t, flags | re.ASCII)
    row = lambda pos: t[:pos].count("\n") + 1
    span = lambda a, b: t[max(0, a) : max(0, b)]

    def add(issue, pos, sure, name=None):
        told.setdefault((row(pos), issue), (sure, name, lines[row(pos) - 1].strip()))

    if ext == ".c":
        threads = re.search("pthread|std::thread|std::mutex|std::atomic|_beginthread", t)
        for m in find(r"\bpthread_create\s*\("):
            if not re.search("pthread_mutex_lock|std::mutex", span(m.start() - 1500, m.end() + 1500)):
                add("race-condition", m.start(), "MEDIUM")
        for m in find(r"\b(?:volatile\s+)?(?:int|long|char|double|float|uint\d+_t)\s+(\w+)\s*="):
            told_line = lines[row(m.start()) - 1]
            if threads and told_line[:1] not in (" ", "\t") and not told_line.lstrip().startswith(("//", "/*", "#", "*")):
                for w in find(rf"\b{m[1]}\s*(?:\+\+|--|[-+*/|&^]?=)"):
                    if lines[row(w.start()) - 1].startswith(("    ", "\t")) and "pthread_mutex_lock" not in span(w.start() - 1500, w.start()) and "atomic" not in span(w.start() - 500, w.start()):
                        add("data-race", w.start(), "LOW", m[1])
        for m in find(r"\bvolatile\s+(?:int|long|bool)\s+(\w+)"):
            if re.search(rf"while\s*\(\s*!?\s*{m[1]}\s*\)", t):
                add("volatile-misuse", m.start(), "HIGH", m[1])
        for m in find(r"(?:static\s+|extern\s+)?(?:int|long|unsigned)\s+(\w*count\w*|\w*total\w*)\s*=\s*0\s*;", re.I):
            if threads and lines[row(m.start()) - 1][:1] not in (" ", "\t") and re.search(rf"\b{m[1]}\s*(?:\+\+|--|[-+]=)", t):
                add("missing-atomic", m.start(), "MEDIUM", m[1])
        for m in find(cc.C_TWICE):
            add("double-checked-locking", m.start(), "HIGH", m[1])
        for m in find(r"~\s*\w+\s*\([^)]*\)\s*\{[^}]*pthread_create"):
            add("thread-in-destructor", m.start(), "HIGH")
    elif ext == ".java":
        for m in find(r"class\s+(\w+)\s+extends\s+Thread\s*\{(.*?)(?=\nclass|\Z)", re.S):
            if "synchronized" not in m[2] and "volatile" not in m[2] and re.search(r"(private|protected|public)\s+(int|long|boolean|String)\s+\w+", m[2]):
                add("unsynchronized-thread", m.start(), "MEDIUM", m[1])
        for m in find(r"Collections\.synchronized(?:List|Map|Set)\s*\("):
            if re.search(r"\.iterator\(\)|for\s*\(.*?:", span(m.end(), m.end() + 3000)) and "synchronized" not in span(m.end(), m.end() + 500):
                add("unsafe-iteration", m.start(), "HIGH")
        for m in find(cc.JAVA_TWICE):
            if "volatile" not in span(m.start() - 500, m.start()):
                add("double-checked-locking", m.start(), "HIGH", m[1])
        for m in find(r"new\s+HashMap\s*<"):
            if ("new Thread" in t or "implements Runnable" in t) and not lines[row(m.start()) - 1].strip().startswith(("//", "*")):
                add("unsynchronized-hashmap", m.start(), "LOW")
        for m in find(r"\.\s*(?:wait|notify|notifyAll)\s*\("):
            if "synchronized" not in span(m.start() - 500, m.start()):
                add("wait-outside-sync", m.start(), "HIGH")
    elif ext == ".go":
        for m in find(cc.LOOPED):
            if f"({m[1]})" not in span(m.start(), m.end() + 300):
                add("goroutine-loop-closure", m.start(), "HIGH", m[1])
        for m in find(r"\bmap\["):
            if "go " in t and re.search(r"\bgo\s+func", span(m.end(), m.end() + 2000)) and not re.search("sync.(RW)?Mutex", span(m.start() - 200, m.start() + 200)):
                add("concurrent-map-write", m.start(), "MEDIUM")
        for m in find(r"go\s+func\s*\([^)]*\)\s*\{[^}]*\.Add\s*\("):
            add("waitgroup-add-in-goroutine", m.start(), "HIGH")
        for m in find(r"\bch\s*<-\s*|<-\s*\bch\b"):
            if not re.search(r"select|time\.After", span(m.start() - 200, m.start() + 200)) and re.search(r"go func|func\(", span(m.start() - 1000, m.start())):
                add("unbuffered-channel-block", m.start(), "LOW")
    elif ext == ".py":
        for m in find(cc.CHANGED):
            before = span(m.start() - 1000, m.start())
            if re.search(r"threading\.Thread|Thread\(target=", before) and not re.search(r"threading\.Lock|with lock", before):
                add("thread-unsafe-mutation", m.start(), "MEDIUM")
        for m in find(r"\basync\s+def\s+\w+"):
            for c in re.finditer(cc.COROUTINE, t[m.end() : m.end() + 2000], re.ASCII):
                if ("async def" in t or "asyncio" in t) and not re.search("await|#", lines[row(m.end() + c.start()) - 1]):
                    add("missing-await", m.end() + c.start(), "HIGH", c[1])
        for m in find(r"multiprocessing\.Process\s*\("):
            if not re.search(r"Manager\(\)|multiprocessing\.Lock", span(m.start() - 500, m.start() + 500)):
                add("multiprocess-unshared", m.start(), "LOW")
        for m in find(r"Thread\s*\([^)]*\)"):
            if "daemon" not in m[0]:
                add("non-daemon-thread", m.start(), "LOW")
    return {(path, line, issue, *rest) for (line, issue), rest in told.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_concurrency(spark, seed):
    rng = random.Random(seed)
    texts = {}
    for k in range(320):
        ext = rng.choice([*PIECES])
        comment = "# " if ext == ".py" else "// "
        pick = lambda: comment + rng.choice(FAR) if rng.random() < 0.15 else rng.choice(PIECES[ext])  # noqa: B023, E731
        texts[f"d/f{k}{ext if rng.random() < 0.9 else ext.upper()}"] = rng.choice(["\n", "\n", "\r\n", "\n  "]).join(pick() for _ in range(rng.randrange(40)))
    files = spark.createDataFrame([*texts.items(), ("null.c", None), ("none", "x.wait()"), ("a.rb", "Thread()"), (None, "Thread()")], "path string, content string")
    told = {tuple(r) for r in cc.concurrency(files).select("path", "line", "issue", "confidence", "name", "snippet").collect()}
    want = set().union(*(brute(p, t) for p, t in texts.items()))
    assert told == want and len({w[2] for w in want}) == 18  # one name is in two languages
    assert cc.concurrency(files.limit(0)).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    text = "import threading\nt = threading.Thread(target=f)\n"
    rows = spark.createDataFrame([("a.py", text, "x", 1)] * 2, "path string, content string, lang string, line int")
    assert [tuple(r) for r in cc.concurrency(rows).collect()] == [("a.py", "python", 2, "non-daemon-thread", "LOW", None, "t = threading.Thread(target=f)")] * 2


def test_places_of_a_long_file(spark):
    text = "é ab\n" * 20000
    told = spark.createDataFrame([(text,)], "t string")
    out = told.select(cc.places(told.t, "a(b)", 1).alias("p")).first().p
    assert len(out) == 20000 and tuple(out[-1]) == (5 * 19999 + 2, 5 * 19999 + 4, 20000, "b")
