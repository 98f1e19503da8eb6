"""Flows that need state along a file: function complexity, silent catches, taint within a file, and taint across calls.

A file, or a function, is parsed by a small Arrow function; everything between functions is joins. Taint across calls is
traced by summaries: for each function and each parameter that may be tainted on entry (and for none), one pass over its
body gives the sinks it reaches and the calls it passes taint to. A frontier of (function, tainted parameter) states then
moves along the calls, level by level, with states seen before left out, until the depth or an empty frontier ends it. Calls and
the functions that they can mean meet at (name, argument, scope), so calls times functions of a name are never made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findgrid.functions.shared import before_it, in_order, save_table, tasks_for
from findgrid.operators.anomaly import SANITIZERS as FILE_SANITIZERS
from findgrid.operators.anomaly import SINKS as FILE_SINKS
from findgrid.operators.anomaly import SOURCES as FILE_SOURCES

# Words of the trace, other than those of the anomaly scan.
SOURCES = (
    "request", "req", "params", "body", "query", "input", "$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "ctx.request", "self.request", "this.request",
    "request.data", "request.json", "request.form", "req.body", "req.query", "req.params", "getParameter", "getQueryString", "HttpServletRequest", "args", "argv", "stdin",
)
SINKS = (
    "exec", "system", "popen", "eval", "assert", "query", "execute", "raw_query", "rawQuery", "shell_exec", "passthru", "proc_open", "os.system", "subprocess.call", "subprocess.Popen", "runtime.exec",
    "ProcessBuilder", "is_admin", "isAdmin", "admin", "grant", "role", "permission", "authorize", "privilege", "sudo", "open(", "write", "delete", "chmod", "unlink",
)
SANITIZERS = ("sanitize", "validate", "escape", "filter", "htmlspecialchars", "strip_tags", "escapeHtml", "escapeShellArg", "escapeshellarg", "parseInt", "parseFloat", "intval", "floatval", "is_numeric", "ctype_digit", "preg_match")
FOCUS = (
    (("admin", "privilege", "escalat", "become", "role", "permission", "is_admin", "authorize", "sudo", "access control"), ("is_admin", "admin", "grant", "role", "permission")),
    (("inject", "sql", "command", "exec", "eval", "shell", "xss", "ssrf"), ("exec", "eval", "query", "system")),
    (("exfil", "leak", "data", "read", "write", "delete", "file", "payment", "secret"), ("write", "open", "delete", "query")),
)
COMPLEX_LINES, COMPLEX_BRANCHES = 80, 6
#: Bytes of text of a task that parses, and files or functions of it if they are short.
TASK_BYTES, TASK_TEXTS = 8 << 20, 20_000
_BRANCH = ("if", "else if", "elif", "match", "switch", "case", "for", "while", "catch")
_WORD = re.compile(r"\w+")
_DECLARED = re.compile(r"(?i)^(?:let mut |let |var |const |val |final )([^=]*)=")
_SIGNATURE = re.compile(r"(?i)\b(?:async\s+)?(?:fn|function|def|func)\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\(|^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")
_CALL = re.compile(r"([A-Za-z][\w.:]*)\(")


def focus_words(question: str) -> list[str]:
    """Sinks that a question is about."""
    q = question.lower()
    return [w for asked, words in FOCUS if any(a in q for a in asked) for w in words]


def _comment(t: str, empty: bool = True) -> bool:
    return (empty and not t) or t.startswith(("//", "#", "/*", "*"))


def _per_file(parse, schema: str):
    cols = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, e, t in zip(b["path"], b["ext"], b["content"], strict=True) for r in parse(p, e, (t or "").split("\n"))], columns=cols)

    return lambda files: files.select("path", "ext", "content").mapInPandas(run, schema)


def _complexity(path, ext, lines):
    depth, open_at = 0, None  # open_at: first line, name, lines, branches
    for i, raw in enumerate(lines, 1):
        t = raw.strip()
        m = _SIGNATURE.search(t)
        if m:
            open_at = [i, m[1] or m[2], 0, 0]
        for c in t:
            if c == "{":
                depth += 1
                if depth == 1 and open_at is None:
                    open_at = [i, "<anonymous>", 0, 0]
            elif c == "}":
                depth -= 1
                if depth <= 0 and open_at is not None:
                    if open_at[2] > COMPLEX_LINES:
                        yield path, open_at[0], open_at[1], "lines", open_at[2]
                    if open_at[3] > COMPLEX_BRANCHES:
                        yield path, open_at[0], open_at[1], "branches", open_at[3]
                    open_at = None
        if open_at is not None:
            open_at[2] += 1
            open_at[3] += t.startswith(_BRANCH)
        depth = max(depth, 0)


complex_functions = _per_file(_complexity, "path string, line_no long, name string, kind string, n long")
complex_functions.__doc__ = "Functions of more than 80 lines, or more than 6 lines that branch, from their signature to the brace that closes them."


def _silent(path, ext, lines):
    start, depth = None, 0
    for i, raw in enumerate(lines, 1):
        t = raw.strip()
        if _comment(t) or t.startswith("--"):
            continue
        low = t.lower()
        if low.startswith(("catch", "except", "rescue", "} catch")):
            start, depth = i, 0
        elif start is not None:
            for c in t:
                depth += (c == "{") - (c == "}")
                if depth < 0:
                    if i - start <= 2 and "log" not in low and "error" not in low:
                        yield path, start, i - start + 1
                    start = None
                    break


silent_catches = _per_file(_silent, "path string, line_no long, lines long")
silent_catches.__doc__ = "Catch blocks of at most two more lines that neither log nor name an error where they end."


def _assigned(t: str) -> str | None:
    m = _DECLARED.match(t)
    if m:
        left = m[1].strip()
        if ":" in left:
            return left.split(":")[0].strip()
        return None if "{" in left or "(" in left or left.startswith("[") else left
    if "=" in t and not re.match("if|for|while", t) and not re.search("[=!<>]=", t):
        left = t.split("=")[0].strip()
        return left if left and " " not in left and "(" not in left else None
    return None


def _file_taint(path, ext, lines):
    tainted: dict[str, int] = {}
    low = [x.strip().lower() for x in lines]
    sources = [s.lower() for s in FILE_SOURCES]
    for i, raw in enumerate(lines):
        t = raw.strip()
        if _comment(t) or t.startswith("--"):
            continue
        at = next((s for s in sources if s in low[i]), None)
        if at:
            name = _assigned(t)
            if name is None:
                before = t[: low[i].find(at)]
                cut = max(before.rfind(","), before.rfind("("))
                part = before[cut + 1 :].strip() if cut >= 0 else ""
                name = part if part and " " not in part and "=" not in part else None
            if name:
                tainted[name.lower()] = i + 1
        if "=" in t:
            name = _assigned(t)
            origin = next((d for v, d in tainted.items() if v in low[i]), None)
            if name and origin is not None:
                tainted.setdefault(name.lower(), origin)
        if any(s in x for x in low[max(0, i - 3) : i + 1] for s in FILE_SANITIZERS):
            continue
        for v, d in tainted.items():
            sink = next((s for s in FILE_SINKS if s in low[i]), None) if v in low[i] else None
            if sink:
                yield path, d, v, i + 1, sink, "Critical" if sink in ("exec", "system", "eval") else "High"


file_taint = _per_file(_file_taint, "path string, line_no long, variable string, sink_line long, sink string, severity string")
file_taint.__doc__ = "Variables of untrusted input that reach a sink without a sanitiser on the line or the three before it; variables in order of first sight."


def _params(text: str) -> list[str]:
    inner, depth = "", 0
    for c in text[text.find("(") + 1 :] if "(" in text else "":
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        inner += c
    out = []
    for p in inner.split(","):
        p = re.sub(r"^(?:mut |let |const |var |&|\*)+", "", p.strip()).split("=")[0].split(":")[0].strip(" '\"")
        if re.match(r"[^\W\d]\w*$", p) and p not in ("self", "this"):
            out.append(p)
    return out


def _functions(path, ext, lines):
    current, depth = None, 0
    for i, raw in enumerate(lines, 1):
        t = raw.strip()
        m = _SIGNATURE.search(t) if depth <= 0 or ext == "py" else None
        ended = current is not None and (m or (ext == "py" and current[4] and t and not _comment(t) and not raw[:1].isspace()))
        if ended:
            yield tuple(current)
            current = None
        if m:
            current = [path, m[1] or m[2], i, _params(t), []]
        elif current is not None and t and not _comment(t) and not re.fullmatch(r"\}[}),;\s]*", t):
            current[4].append({"line": i, "text": t})
        for c in t if "{" in t or "}" in t else "":
            depth += (c == "{") - (c == "}")
            if c == "}" and depth <= 0 and current is not None:
                yield tuple(current)
                current = None
        depth = max(depth, 0)
    if current is not None:
        yield tuple(current)


functions = _per_file(_functions, "path string, name string, start_line long, params array<string>, body array<struct<line: long, text: string>>")
functions.__doc__ = "The functions of files: name, first line, parameters, and the body without blanks, comments and closing lines."


def calls_of(line: str) -> list[tuple[str, list[str]]]:
    """(callee, arguments) of the calls of a line; the text of a call inside another's arguments stays an argument."""
    out, at = [], 0
    while m := _CALL.search(line, at):
        depth, args, cur, end = 0, [], "", None
        for k in range(m.end(), len(line)):
            c = line[k]
            if c == ")" and depth == 0:
                end = k
                break
            if c == "," and depth == 0:
                args.append(cur.strip())
                cur = ""
                continue
            depth += (c == "(") - (c == ")")
            cur += c
        if end is None:
            at = m.end()
            continue
        out.append((m[1].strip("."), [a for a in (*args, cur.strip()) if a]))
        at = end + 1
    return out


def _uses(text: str, names) -> str | None:
    words = {w.lower() for w in _WORD.findall(text)}
    return next((n for n in names if n.lower() in words), None)


def _summary(name, params, body, entry, focus):
    """Events of a body when `entry` is tainted: (kind, line, target, argument, hops, detail); hops counts the steps in the function
    so far. A step is an event too: of kind source or flow, and hops its number from 1."""
    tainted = [entry] if entry else []
    hops = 0
    for line, t in body:
        low = t.lower()
        plain = "=" in t and not re.search(r"==|>=|<=", t)
        left = (t.split("=")[0].split() or [""])[-1].strip(";,") if plain else ""
        right = t.split("=", 1)[1].lower() if plain else ""
        if plain and "!=" not in t and any(s in right for s in SOURCES) and re.fullmatch(r"[^\W\d]\w*", left):
            if left not in tainted:
                tainted.append(left)
                hops += 1
                yield "source", line, left, -1, hops, f"untrusted input enters '{left}'"
            continue
        if not tainted:
            continue  # nothing that could flow on
        clean = any(s in low for s in SANITIZERS)  # stops flow and sinks on the line, not calls
        if not clean and left and "(" not in left and left not in tainted and (origin := _uses(right, tainted)):
            tainted.append(left)
            hops += 1
            yield "flow", line, left, -1, hops, f"'{left}' takes tainted '{origin}'"
        used = _uses(t, tainted)
        sink = next((s for s in (*focus, *SINKS) if s in low), None) if used and not clean else None
        if sink:
            yield "sink", line, sink, -1, hops, f"tainted data reaches '{sink}'"
            continue
        for callee, args in calls_of(t) if used else ():
            for k, a in enumerate(args):
                if _uses(a, tainted):
                    yield "call", line, callee.lower(), k, hops, f"calls {callee}({a}) with tainted data"


def summaries(funcs: DataFrame, question: str = "") -> DataFrame:
    """Rows (path, name, start_line, entry, kind, line, target, arg, hops, detail): what a function does with taint that enters by the
    parameter `entry`, or that it reads itself (entry null)."""
    focus = focus_words(question)
    cols = ["path", "name", "start_line", "entry", "kind", "line", "target", "arg", "hops", "detail"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in b.itertuples(index=False):
                body = [(x["line"], x["text"]) for x in f.body]
                for entry in (None, *f.params):
                    rows += [(f.path, f.name, f.start_line, entry, *e) for e in _summary(f.name, f.params, body, entry, focus)]
            yield pd.DataFrame(rows, columns=cols)

    return funcs.mapInPandas(run, "path string, name string, start_line long, entry string, kind string, line long, target string, arg long, hops long, detail string")


_STATE = ("path", "start_line", "entry")


def _parsed(files: DataFrame, question: str) -> tuple[DataFrame, DataFrame]:
    """Stored functions of files and their summaries. Files and functions are dealt out into tasks of bounded text before they are
    parsed, however few files of a table hold them."""
    files = save_table(files.select("path", "ext", "content"), "files")
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")).first()
    n = max(tasks_for(files.sparkSession, size["bytes"], TASK_BYTES), tasks_for(files.sparkSession, size["n"], TASK_TEXTS))
    funcs = save_table(functions(files.repartition(n, "path")), "functions")
    n = max(n, tasks_for(files.sparkSession, funcs.count(), TASK_TEXTS))
    return funcs, save_table(summaries(funcs.repartition(n, "path", "start_line"), question), "summaries")


#: Where calls meet functions: the callee's name, the place of the argument, and the file ("/path"; "" for all files).
_MEET = ("target", "arg", "scope")


def _meeting(s: DataFrame, funcs: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored calls of summaries with the scope in which their callee is looked up, the same file if it has a function of that name,
    else all files; and stored entries (_MEET, t_path, t_line, t_entry): the parameters that such an argument becomes. All
    functions of a name count, or the first `most` of them in each scope."""
    named = funcs.select(F.lower("name").alias("target"), F.col("path").alias("t_path"), F.col("start_line").alias("t_line"), "params")
    own = F.concat(F.lit("/"), "t_path")
    to = named.withColumn("scope", own).unionByName(named.withColumn("scope", F.lit("")))
    if most is not None:
        to = to.withColumn("r", F.row_number().over(Window.partitionBy("target", "scope").orderBy("t_path", "t_line"))).filter(F.col("r") <= most)
    entries = to.select("target", "scope", "t_path", "t_line", F.posexplode("params").alias("arg", "t_entry")).withColumn("arg", F.col("arg").cast("long"))
    local = named.select("target", F.col("t_path").alias("path"), own.alias("scope")).distinct()
    calls = s.filter("kind = 'call'").select(*_STATE, "line", "target", "arg", "hops", "detail")
    calls = calls.join(named.select("target").distinct(), "target", "left_semi").join(local, ["target", "path"], "left").withColumn("scope", F.coalesce("scope", F.lit("")))
    return save_table(calls, "calls"), save_table(entries, "entries")


def taint_paths(files: DataFrame, depth: int | None = 4, callees: int | None = 2, question: str = "") -> tuple[DataFrame, DataFrame]:
    """Paths (path_id, source_path, source_line, sink_path, sink_line, sink, risk, calls) of taint that reaches a sink over at most
    `depth` calls, each to the first `callees` functions of its name (None: any number of calls, all functions), and their steps
    (path_id, step, file, line, function, action, detail).

    The source is the line where input enters, the first step of the path. A state (function, tainted parameter) is entered once, at
    the level it is first seen at, from the caller with the least (steps, source); that caller stays as its back-pointer. Steps are
    rebuilt from the sinks backwards, a join for each level: the steps of each function up to the call or the sink, the calls
    between. The risk counts the steps of the function that holds the sink. Sources that reach a state later make no paths of
    their own; linked_files() tells all files that a path connects."""
    funcs, s = _parsed(files, question)
    calls, entries = _meeting(s, funcs, callees)
    step = calls.select(*(F.col(c).alias(f"s_{c}") for c in _STATE), "line", "hops", "detail", *_MEET)
    sinks = s.filter("kind = 'sink'").select(*(F.col(c).alias(f"s_{c}") for c in _STATE), F.col("line").alias("sink_line"), F.col("target").alias("sink"), F.col("hops").alias("sink_hops"), F.col("detail").alias("sink_detail"))
    on = (F.col("path") == F.col("s_path")) & (F.col("start_line") == F.col("s_start_line")) & F.col("entry").eqNullSafe(F.col("s_entry"))
    # roots read untrusted input themselves
    root = s.filter("entry IS NULL AND kind = 'source' AND hops = 1").select(*_STATE, F.lit(0).cast("long").alias("so_far"), F.col("path").alias("r_path"), F.col("line").alias("r_line"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("b_path", "string"), ("b_start_line", "long"), ("b_entry", "string"), ("b_line", "long"), ("b_hops", "long"), ("b_detail", "string"))]
    fronts = [save_table(root.select("*", *none), "frontier")]
    seen = fronts[0].select(*_STATE)
    while depth is None or len(fronts) <= depth:
        back = F.struct((F.col("so_far") + F.col("hops") + 1).alias("so_far"), "r_path", "r_line", F.col("s_path").alias("b_path"), F.col("s_start_line").alias("b_start_line"), F.col("line").alias("b_line"), F.col("s_entry").alias("b_entry"), F.col("hops").alias("b_hops"), F.col("detail").alias("b_detail"))
        moved = fronts[-1].select(*_STATE, "so_far", "r_path", "r_line").join(step, on).groupBy(*_MEET).agg(F.min(back).alias("m"))
        moved = moved.join(entries, list(_MEET)).groupBy(F.col("t_path").alias("path"), F.col("t_line").alias("start_line"), F.col("t_entry").alias("entry")).agg(F.min("m").alias("m"))
        front = save_table(moved.join(seen, list(_STATE), "left_anti").select(*_STATE, "m.*").select(fronts[0].columns), "frontier")
        if front.isEmpty():
            break
        fronts.append(front)
        seen = seen.unionByName(front.select(*_STATE))
    found = None
    for level, front in enumerate(fronts):
        here = front.join(sinks, on).select(*_STATE, "r_path", "r_line", "sink_line", "sink", "sink_hops", "sink_detail", F.lit(level).cast("long").alias("calls"))
        found = here if found is None else found.unionByName(here)
    k = F.col("sink")
    base = F.when(k.isin("exec", "system", "eval"), 9.0).when(k.isin("is_admin", "admin", "grant"), 8.5).when(k.contains("query") | k.isin("open", "write"), 7.5).otherwise(6.0)
    path_id = F.sha2(F.concat_ws("|", "path", "start_line", F.coalesce("entry", F.lit("")), "sink_line"), 256)
    found = save_table(found.withColumn("path_id", path_id).withColumn("risk", F.least(base + F.col("sink_hops") * 0.3, F.lit(10.0))), "paths")
    paths = found.select("path_id", F.col("r_path").alias("source_path"), F.col("r_line").alias("source_line"), F.col("path").alias("sink_path"), "sink_line", "sink", "risk", "calls")

    # backwards: (path_id, the state, the steps of it that count, what ends it)
    named = funcs.select(F.col("path").alias("f_path"), F.col("start_line").alias("f_line"), F.col("name").alias("function"))
    own = s.filter("kind IN ('source', 'flow')").select(*(F.col(c).alias(f"s_{c}") for c in _STATE), "line", "kind", F.col("hops").alias("no"), "detail")
    at = found.select("path_id", F.col("calls").alias("level"), *_STATE, F.col("sink_hops").alias("upto"), F.col("sink_line").alias("end_line"), F.lit("sink").alias("end"), F.col("sink_detail").alias("end_detail"))
    parts, late = [], None
    for level in range(len(fronts) - 1, -1, -1):
        here = at.filter(F.col("level") == level)
        here = save_table(here if late is None else here.unionByName(late), "walk")
        parts.append(here.join(own, on).filter(F.col("no") <= F.col("upto")).select("path_id", "level", "no", F.col("path").alias("file"), "start_line", "line", F.col("kind").alias("action"), "detail"))
        parts.append(here.select("path_id", "level", (F.col("upto") + 1).alias("no"), F.col("path").alias("file"), "start_line", F.col("end_line").alias("line"), F.col("end").alias("action"), F.col("end_detail").alias("detail")))
        if level:
            prev = here.join(fronts[level].select(*_STATE, "b_path", "b_start_line", "b_entry", "b_line", "b_hops", "b_detail"), list(_STATE))
            late = prev.select("path_id", F.lit(level - 1).cast("long").alias("level"), F.col("b_path").alias("path"), F.col("b_start_line").alias("start_line"), F.col("b_entry").alias("entry"), F.col("b_hops").alias("upto"), F.col("b_line").alias("end_line"), F.lit("call").alias("end"), F.col("b_detail").alias("end_detail"))
    steps = parts[0]
    for p in parts[1:]:
        steps = steps.unionByName(p)
    number = F.row_number().over(Window.partitionBy("path_id").orderBy("level", "no")).cast("long")  # a path's few steps
    steps = steps.withColumn("step", number).join(named, (F.col("file") == F.col("f_path")) & (F.col("start_line") == F.col("f_line")), "left")
    return paths, steps.select("path_id", "step", "file", "line", "function", "action", "detail")


def trace(files: DataFrame, depth: int | None = 4, callees: int | None = 2, question: str = "") -> DataFrame:
    """The paths of taint_paths()."""
    return taint_paths(files, depth, callees, question)[0]


def linked_files(files: DataFrame, question: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, sinks, links): all pairs of a file whose untrusted input reaches a sink and the file of that sink, over any number of
    calls and all functions of a callee's name.

    sources (path, from_class) and sinks (path, to_class) put files into classes, links (from_class, to_class) connect classes; a
    pair of files is in exactly one link if a path connects it, else in none. Files that hand taint to the same names are one
    class, and so are those with sinks behind the same names, so pairs of files are not made.

    Taint is followed by origin: the input of a file, or a hub (name, argument), at which the calls of other files meet all
    functions of the name. Within a file a state is entered once by each origin; a hub is started once, however many files call it."""
    funcs, s = _parsed(files, question)
    calls, entries = _meeting(s, funcs)
    state = ("path", "start_line", F.coalesce("entry", F.lit("")).alias("entry"))
    hub = F.concat_ws(" ", "arg", "target")
    calls = save_table(calls.select(*state, *_MEET, hub.alias("hub")).distinct(), "calls")
    ends = s.filter("kind = 'sink'").select(*state).distinct()
    is_file = F.col("origin").startswith("file ")
    front = save_table(s.filter("entry IS NULL AND kind = 'source' AND hops = 1").select(F.concat(F.lit("file "), "path").alias("origin"), *state).distinct(), "frontier")
    seen, called, level = front, None, 0
    while not front.isEmpty():
        out = save_table(front.join(calls, list(_STATE)).select("origin", *_MEET, "hub").distinct(), "called")
        across = out.filter("scope = ''")
        new = across.select(F.col("hub").alias("origin"), *_MEET).distinct()
        if called is not None:
            new = new.join(called.select(F.col("hub").alias("origin")), "origin", "left_anti")
        go = out.filter("scope <> ''").select("origin", *_MEET).unionByName(new).join(entries, list(_MEET))
        go = go.select("origin", F.col("t_path").alias("path"), F.col("t_line").alias("start_line"), F.col("t_entry").alias("entry")).distinct()
        front = save_table(go.join(seen, ["origin", *_STATE], "left_anti"), "frontier")
        across = across.select("origin", "hub")
        seen, called, level = seen.unionByName(front), across if called is None else called.unionByName(across), level + 1
        if level % 16 == 0:  # plans stay short on long chains
            seen, called = save_table(seen, "seen"), save_table(called, "called")
    reached = save_table(seen.join(ends, list(_STATE), "left_semi").select("origin", "path").distinct(), "reached")
    called = save_table((front.select("origin", F.lit("").alias("hub")) if called is None else called).distinct(), "called")

    def classes(files_and_hubs, name):
        """Files by their set of hubs: (path, class), and the hubs of each class."""
        c = files_and_hubs.groupBy("path").agg(F.array_sort(F.collect_set("hub")).alias("hubs")).withColumn(name, F.sha2(F.array_join("hubs", "\n"), 256))
        c = save_table(c, "classes")
        return c.select("path", name), c.select(name, "hubs").dropDuplicates([name]).select(name, F.explode("hubs").alias("hub"))

    sources, from_hubs = classes(called.filter(is_file).select(F.expr("substring(origin, 6)").alias("path"), "hub"), "from_class")
    sinks, to_hubs = classes(reached.filter(~is_file).select("path", F.col("origin").alias("hub")), "to_class")
    # hubs that taint gets to from those which files call
    edges = called.filter(~is_file).select(F.col("origin").alias("hub"), F.col("hub").alias("next"))
    front = save_table(from_hubs.select(F.col("hub").alias("first"), "hub").distinct(), "hubs")
    reach, level = front, 0
    while not front.isEmpty():
        front = save_table(front.join(edges, "hub").select("first", F.col("next").alias("hub")).distinct().join(reach, ["first", "hub"], "left_anti"), "hubs")
        reach, level = reach.unionByName(front), level + 1
        if level % 16 == 0:
            reach = save_table(reach, "hubs")
    links = from_hubs.withColumnRenamed("hub", "first").join(reach, "first").select("from_class", "hub").distinct().join(to_hubs, "hub").select("from_class", "to_class").distinct()
    links = save_table(links, "links")
    # a file whose input reaches its own sinks, where no link says so: a class of its own on both sides
    alone = reached.filter(is_file).select("path").distinct().join(sources, "path", "left").join(sinks, "path", "left").join(links, ["from_class", "to_class"], "left_anti")
    alone = save_table(alone.select("path", F.concat(F.lit("file "), "path").alias("from_class"), F.concat(F.lit("file "), "path").alias("to_class")), "links")
    return sources.unionByName(alone.select("path", "from_class")), sinks.unionByName(alone.select("path", "to_class")), links.unionByName(alone.select("from_class", "to_class"))


def dedup_paths(paths: DataFrame) -> DataFrame:
    """Paths by falling risk, each that has the source and sink of the one before it dropped, numbered TRACE-n."""
    by = (F.desc("risk"), "source_path", "source_line", "sink_path", "sink_line", "sink")
    key = F.concat_ws("|", "source_path", "source_line", "sink_path", "sink_line")
    kept = before_it(in_order(paths, *by), key, "_p").filter(F.col("_p").isNull() | (F.col("_p") != key)).select(paths.columns)
    return in_order(kept, *by).withColumn("id", F.concat(F.lit("TRACE-"), F.col("_no").cast("string"))).drop("_no")


def between_files(paths: DataFrame, source: str, sink: str) -> DataFrame:
    """Paths from one file to another; either name may be a suffix of the other."""
    match = lambda c, x: c.endswith(x) | F.lit(x).endswith(c)
    return paths.filter(match(F.col("source_path"), source) & match(F.col("sink_path"), sink))
