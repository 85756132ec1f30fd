"""Taint that crosses files: a caller's tainted names in calls of imported functions, and tainted values that functions hand back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.joins import joined
from lumenfold.operators.scan import language, plain
from lumenfold.sources.text import lines

# By extension (fixed values); headers of C count as C, JavaScript's kin as js.
EXTENSIONS = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust",
    ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".ts": "js", ".tsx": "js",
}
# What brings data in from outside, as text within a line, by language; the first in order counts (fixed values).
SOURCES = {
    "c": ["recv", "read", "fgets", "fread", "gets", "scanf", "fscanf", "getenv", "getline", "recvfrom", "recvmsg"],
    "cpp": ["recv", "read", "fgets", "cin", "getline", "getenv", "scanf"],
    "python": ["input", "request.args", "request.form", "request.json", "request.data", "request.get_json", "sys.stdin", "os.environ", "flask.request", "django.request"],
    "java": ["getParameter", "getHeader", "getInputStream", "getReader", "readLine", "Scanner.next", "BufferedReader.readLine"],
    "go": ["http.Request", "r.FormValue", "r.URL.Query", "bufio.Scanner", "os.Stdin", "ioutil.ReadAll"],
    "rust": ["std::io::stdin", "std::io::Read", "std::env::args", "std::env::var", "hyper::Request"],
    "js": ["req.body", "req.query", "req.params", "process.env", "readline", "fs.readFileSync"],
}
# What must not get such data, as text within a function or file, by language (fixed values).
SINKS = {
    "c": ["system", "exec", "popen", "strcpy", "memcpy", "sprintf", "strcat", "gets", "printf"],
    "cpp": ["system", "exec", "popen", "strcpy", "memcpy", "sprintf"],
    "python": ["eval", "exec", "os.system", "subprocess.call", "subprocess.run", "subprocess.Popen", "cursor.execute", "render_template_string"],
    "java": ["Runtime.exec", "ProcessBuilder", "Statement.execute", "PreparedStatement.execute", "ObjectInputStream"],
    "go": ["exec.Command", "os.Exec", "sql.Query", "fmt.Fprintf", "template.HTML"],
    "rust": ["std::process::Command", "std::ptr::write", "libc::system"],
    "js": ["eval", "child_process.exec", "child_process.spawn", "db.query", "res.send", "innerHTML"],
}
# Where a function is defined, by language (fixed values): name and parameters in groups 1 and 2, or 3 and 4.
FUNCTIONS = {
    "c": r"(?:int|void|char|long|size_t|unsigned|static|inline)\s+\*?\s*(\w+)\s*\(([^)]*)\)\s*\{",
    "cpp": r"(?:int|void|char|long|size_t|unsigned|auto|static|inline|virtual)\s+\*?\s*(\w+)\s*\(([^)]*)\)\s*(?:const\s*)?\{",
    "python": r"(?d)def\s+(\w+)\s*\(([^)]*)\)\s*(?:->.*?)?:",
    "java": r"(?:public|private|protected|static|final|abstract|synchronized)?\s*\w+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+\w+(?:,\s*\w+)*)?\s*\{",
    "go": r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)",
    "rust": r"(?:pub\s+)?fn\s+(\w+)\s*\(([^)]*)\)",
    "js": r"(?:function\s+(\w+)\s*\(([^)]*)\)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(?([^)]*)\)?\s*=>)",
}
# Endings that an import without one may stand for, in order; words that look like a name that gets a value (fixed values).
ENDINGS = ["", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"]
WORDS = ["if", "while", "for", "return", "assert", "raise"]
#: So many characters behind a function's head count as its body (a fixed rule, not a cap on its size).
BODY = 2000


def _by_language(lang: Column, told: dict[str, Column]) -> Column:
    cases = F
    for name, value in told.items():
        cases = cases.when(lang == name, value)
    return cases


def _holds_any(text: Column, lang: Column, words: dict[str, list[str]]) -> Column:
    return F.coalesce(_by_language(lang, {k: F.exists(F.array(*map(F.lit, w)), lambda x: text.contains(x)) for k, w in words.items()}), F.lit(False))


def normalised(path: Column) -> Column:
    """Without empty parts, dots, and parts that two dots take back; two dots at a root stand for nothing; nothing is a dot."""

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != "..")
        kept = F.when((part == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(part)))
        return F.when(part.isin("", "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(kept)

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(whole == "", ".").otherwise(whole)


def stem(path: Column) -> Column:
    """Without its extension; dots that a base name begins with are none."""
    return F.regexp_replace(path, r"^(.*[^/.][^/]*)\.[^./]*$", "$1")


def _beside(path: Column, name: Column) -> Column:
    """The name as a path that begins in the folder of the path's file; as it is if it begins at the root."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(name.startswith("/") | (folder == "") & ~path.startswith("/"), name).otherwise(F.concat(folder, F.lit("/"), name))


def import_targets(files: DataFrame) -> DataFrame:
    """path, target, exists: what each file's (path, content) imports stand for as paths, beside the importing file.

    Each once. Dotted names and names of crates get their language's ending; names of packages that are folders stay
    folders. A name of JavaScript is the first of its possible endings that is a file, and itself if none is.
    """
    path, text, lang = F.col("path"), plain(F.col("content")), language(F.col("path"), EXTENSIONS)
    every = lambda pattern, of=text, group=1: F.regexp_extract_all(of, F.lit(pattern), F.lit(group))
    python = r"(?md)^(?:from\s+([\w.]+)\s+import\s+([\w, ]+)|import\s+([\w.]+))"
    blocks = F.flatten(F.transform(every(r"\bimport\s*\(([^)]*)\)"), lambda b: every(r'"([^"]+)"', b)))
    slashed = lambda names, sign: F.transform(names, lambda n: F.replace(n, F.lit(sign), F.lit("/")))
    names = {
        "c": every(r'#include\s*"([^"]+)"'),
        "cpp": every(r'#include\s*"([^"]+)"'),
        "python": slashed(F.zip_with(every(python), every(python, group=3), lambda a, b: F.when(a != "", a).otherwise(b)), "."),
        "java": slashed(every(r"(?md)^import\s+([\w.]+)(?:\.\*)?;"), "."),
        "go": F.filter(F.concat(every(r'(?md)^import\s+"([^"]+)"'), blocks), lambda n: n.startswith(".") | n.contains("/")),
        "js": F.filter(every(r"""(?d)(?:import\s+.*?\s+from\s+|require\s*\(\s*)["']([^"']+)["']"""), lambda n: n.startswith(".")),
        "rust": slashed(every(r"(?md)^(?:use|mod)\s+([\w:]+)"), "::"),
    }
    told = files.select("path", lang.alias("lang"), F.explode(F.array_distinct(_by_language(lang, names))).alias("name"))
    ending = F.element_at(F.create_map(*map(F.lit, ["python", ".py", "java", ".java", "rust", ".rs"])), F.col("lang"))
    one = F.when(F.col("lang").isin("c", "cpp", "go"), normalised(_beside(path, F.col("name")))).otherwise(F.concat(_beside(path, F.col("name")), ending))
    some = F.array(*(normalised(_beside(path, F.concat("name", F.lit(e)))) for e in ENDINGS))
    tried = told.select("path", "name", F.col("lang") == "js", F.posexplode(F.when(F.col("lang") == "js", some).otherwise(F.array(one))).alias("k", "target")).toDF("path", "name", "js", "k", "target")
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("known")).distinct()
    met = joined(tried, known, ["target"], "left").groupBy("path", "name").agg(F.min(F.when(F.col("known"), F.struct("k", "target"))).alias("hit"), F.min(F.when(F.col("k") == 0, F.struct("js", "target"))).alias("own"))
    target = F.coalesce("hit.target", F.when(F.col("own.js"), F.col("name")).otherwise(F.col("own.target")))
    return met.select("path", target.alias("target"), F.col("hit").isNotNull().alias("exists")).distinct()


def _heads(text: Column, pattern: str) -> Column:
    """Each match of a function's head: array of (line, end, name, params)."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("b"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(5 if "|(?:const" in pattern else 3)))
    kind = "array<struct<line:int,end:int,name:string,params:string>>"
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    wide = "|(?:const" in pattern

    def step(acc: Column, s: Column) -> Column:
        line, end = acc["line"] + breaks(s["b"]), acc["end"] + F.length(s["b"]) + F.coalesce(F.length(s["g0"]), F.lit(0))
        pick = lambda a, b: F.when(s[a] != "", s[a]).otherwise(s[b]) if wide else s[a]
        hit = F.struct(line.cast("int").alias("line"), end.cast("int").alias("end"), pick("g1", "g3").alias("name"), pick("g2", "g4").alias("params"))
        out = F.when(s["g0"].isNotNull(), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct((line + F.coalesce(breaks(s["g0"]), F.lit(0))).cast("int").alias("line"), end.cast("int").alias("end"), out.cast(kind).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(1).alias("line"), F.lit(0).alias("end"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def functions(files: DataFrame) -> DataFrame:
    """path, pos, func, line, params, tainted_params, has_sink, returns_tainted: the functions that files (path, content) define.

    params: the last word of each parameter, without stars and ampersands. Parameters are tainted (by position) if they
    and any sink stand in the body; it returns tainted data if a source and a return do. Files of unknown languages and
    null contents define none.
    """
    text, lang = F.col("text"), F.col("lang")
    rows = files.select("path", plain(F.col("content")).alias("text"), language(F.col("path"), EXTENSIONS).alias("lang"))

    def told(head: Column) -> Column:
        body = F.substring(text, head["end"] + 1, F.lit(BODY))
        parts = F.filter(F.transform(F.split(head["params"], ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
        params = F.transform(parts, lambda p: F.regexp_replace(F.regexp_extract(p, r"(\S+)$", 1), r"^[*&]+|[*&]+$", ""))
        sink = _holds_any(body, lang, SINKS)
        places = F.filter(F.transform(params, lambda p, i: F.when(sink & (p != "") & body.contains(p), i)), lambda i: i.isNotNull())
        out = _holds_any(body, lang, SOURCES) & body.contains("return")
        return F.struct(head["name"].alias("func"), head["line"].alias("line"), params.alias("params"), places.alias("tainted_params"), sink.alias("has_sink"), out.alias("returns_tainted"))

    heads = F.filter(_by_language(lang, {k: _heads(text, p) for k, p in FUNCTIONS.items()}), lambda h: h["name"] != "")
    return rows.select("path", F.posexplode(F.transform(heads, told)).alias("pos", "f")).select("path", "pos", "f.*")


def _text_lines(files: DataFrame) -> DataFrame:
    """path, line, text, lang; a bracket that a call has on a later line also stands behind the called name."""
    lang = language(F.col("path"), EXTENSIONS)
    marked = F.when(lang.isin("c", "cpp"), F.col("content")).otherwise(F.regexp_replace(plain(F.col("content")), r"(\w)(\s*\n\s*)\(", "$1($2("))
    return lines(files.filter(lang.isNotNull()).select("path", marked.alias("content"))).withColumn("lang", lang)


def receiver(text: Column) -> Column:
    """The name that a line puts its data in: the first word before an equals sign, else the first argument of a call; or null."""
    given = F.regexp_extract(text, r"^\s*(\w+)\s*(?:[:,]?\s*\w*\s*)?=", 1)
    first = F.regexp_extract(text, r"\w+\s*\(\s*(\w+)\s*[,)]", 1)
    return F.nullif(F.when((given != "") & ~given.isin(*WORDS), given).otherwise(first), F.lit(""))


def source_lines(files: DataFrame) -> DataFrame:
    """path, line, source, var: lines that bring data in, by the first source in order, and the name that gets it, or null."""
    text = F.col("text")
    first = {k: F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words)) for k, words in SOURCES.items()}
    found = _text_lines(files).withColumn("source", _by_language(F.col("lang"), first)).filter("source is not null")
    return found.select("path", "line", "source", receiver(text).alias("var"))


def flows_in(files: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
    """Calls of imported functions that take a tainted name to a sink: one row for each source line, function and file.

    files: path, content, one row a path; targets and known: import_targets() and functions() of them. Words of calling
    lines meet imported functions by equal names, and words from the function's name on meet tainted names: an index of
    words in place of a pattern for each pair. Of several definitions of a name in a file the first counts, and the
    first call.
    """
    able = known.filter("has_sink or size(tainted_params) > 0").groupBy(F.col("path").alias("target"), "func")
    able = able.agg(F.min(F.struct("pos", "line"))["line"].alias("sink_line"))
    taken = source_lines(files).filter("var is not null")
    arcs = targets.filter("exists").select("path", "target")
    text = _text_lines(joined(files, arcs.select("path").distinct(), ["path"], "left_semi"))
    called = F.when(F.col("lang").isin("c", "cpp"), F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1))).otherwise(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1)))
    calls = text.select("path", "line", F.explode(F.array_distinct(called)).alias("func"))
    met = joined(joined(joined(calls, arcs, ["path"]), able, ["target", "func"]), text.select("path", "line", "text"), ["path", "line"])
    args = F.regexp_extract_all(F.expr("substring(text, instr(text, func))"), F.lit(r"(\w+)"), F.lit(1))
    met = met.select("path", "target", "func", "sink_line", "line", F.explode(F.array_distinct(args)).alias("var"))
    met = met.groupBy("path", "target", "func", "sink_line", "var").agg(F.min("line").alias("call_line"))
    return joined(met, taken, ["path", "var"]).select(
        F.lit("cross-file-taint-flow").alias("kind"), F.col("path").alias("source_file"), F.col("line").cast("int").alias("source_line"), F.col("source").alias("source_function"),
        F.col("target").alias("sink_file"), "sink_line", F.col("func").alias("sink_function"), F.col("call_line").cast("int").alias("call_line"), F.lit(7.5).alias("risk"),
    )


def flows_out(files: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
    """Functions that return tainted data, and files with a sink that import theirs and name them: one row for each line and file.

    An import means a file by its path, or by its path whatever its extension (a header for its source). A file's names to
    look for go to its content as one array, so a content is shuffled once.
    """
    giving = known.filter("returns_tainted").groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "func"))).alias("all"))
    giving = giving.select(F.col("path").alias("from"), stem(F.col("path")).alias("stem"), F.col("line").alias("at"), F.transform("all", lambda f: f["func"]).alias("funcs"))
    arcs = targets.select("path", stem(F.col("target")).alias("stem")).distinct()
    wanted = joined(arcs, giving, ["stem"]).filter(F.col("path") != F.col("from")).groupBy("path").agg(F.collect_list(F.struct("from", "at", "funcs")).alias("wanted"))
    lang = language(F.col("path"), EXTENSIONS)
    text = files.filter(_holds_any(F.col("content"), lang, SINKS)).select("path", plain(F.col("content")).alias("text"))
    # functions that share a line share a finding, named by the first that the file names
    named = F.transform("wanted", lambda w: F.struct(w["from"].alias("from"), w["at"].alias("at"), F.get(F.filter(w["funcs"], lambda n: F.col("text").contains(n)), F.lit(0)).alias("func")))
    found = joined(text, wanted, ["path"]).select("path", F.explode(F.filter(named, lambda w: w["func"].isNotNull())).alias("w"))
    return found.select(
        F.lit("cross-file-taint-return").alias("kind"), F.col("w.from").alias("source_file"), F.col("w.at").alias("source_line"), F.col("w.func").alias("source_function"),
        F.col("path").alias("sink_file"), F.lit(0).alias("sink_line"), F.lit("(caller)").alias("sink_function"), F.lit(None).cast("int").alias("call_line"), F.lit(6.5).alias("risk"),
    )


def cross_file_taint(files: DataFrame) -> DataFrame:
    """Both ways: kind, source_file, source_line, source_function, sink_file, sink_line, sink_function, call_line, risk.

    files: path, content. Each source line, sink file and sink function is told once.
    """
    targets, known = import_targets(files), functions(files)
    return flows_in(files, targets, known).unionByName(flows_out(files, targets, known))
