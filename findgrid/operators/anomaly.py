"""Anomalies that need neighbouring lines: window frames over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrid.functions.scores import cascade, contains_any, ladder, strip

# Words of untrusted input, of dangerous calls and of sanitising.
SOURCES = (
    "request", "req", "params", "body", "query", "input", "$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "ctx.request", "self.request", "this.request",
    "args", "kwargs", "argv", "stdin", "get_query_params", "get_json_args", "form_data", "request.data", "request.json", "request.form", "req.body", "req.query", "req.params",
    "getInput", "getParameter", "getQueryString", "HttpServletRequest", "HttpRequest",
)
SINKS = (
    "exec", "system", "popen", "eval", "assert", "query", "execute", "raw_query", "rawQuery", "open", "write", "delete", "chmod", "unlink", "fs.writeFile", "fs.writeFileSync", "fs.appendFile",
    "os.system", "subprocess.call", "subprocess.Popen", "shell_exec", "passthru", "proc_open", "runtime.exec", "ProcessBuilder", "cmd.exe", "/bin/sh", "/bin/bash",
)
SANITIZERS = (
    "sanitize", "validate", "escape", "filter", "htmlspecialchars", "htmlentities", "strip_tags", "escapeHtml", "escapeShellArg", "escapeshellarg", "encodeURI", "encodeURIComponent",
    "parseInt", "parseFloat", "Number", "intval", "floatval", "filter_var", "is_numeric", "ctype_digit", "preg_match", "str_replace", "preg_replace",
)
INDEXED = ("array[", "list[", "vector[", "arr[", "data[", "items[", "results[", "records[", "rows[")
CHECKED = (".len()", ".length", "count(", "sizeof", "is_empty", "isempty", "isset(", "array_key_exists", "in_array", "contains_key", "has_index")
FILE_CALLS = ("open(", "fopen(", "readfile(", "file_get_contents", "fs::read", "File::open")
PATH_CHECKS = ("..", "basename", "realpath", "canonicalize", "sanitize")
# Rating of each anomaly.
RATING = (
    ("proximity", "Dangerous API called near user-controlled data", "High", "Medium", "CWE-74", "A03:2021"),
    ("bounds", "Array/list access without bounds check", "High", "Low", "CWE-125", "A04:2021"),
    ("transmute", "Unsafe type transmute detected", "High", "High", "CWE-843", "A02:2021"),
    ("pointer", "Unsafe pointer near data handling", "Critical", "Medium", "CWE-843", "A02:2021"),
    ("any_cast", "Type-safety bypass: 'any' cast or @ts-ignore", "Medium", "Medium", "CWE-843", "A02:2021"),
    ("tainted_path", "User-controlled path reaches file operation without validation", "Critical", "Medium", "CWE-22", "A03:2021"),
    ("silent_except", "Exception silently swallowed", "Medium", "Medium", "CWE-532", "A09:2021"),
)


def is_comment(trimmed: Column) -> Column:
    return (trimmed == "") | trimmed.rlike(r"^(//|#|/\*|\*|--)")


def _lower(words) -> list[str]:
    return [w.lower() for w in words]


def flagged(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Lines with t (trimmed), low, code, source and sink. Unless strict, sinks are looked for as they are spelt in the
    lower-cased line, so those with a capital never match."""
    t = strip(F.col("line"))
    l = lines.select("path", "ext", "line_no", t.alias("t"), F.lower(t).alias("low"), (~is_comment(t)).alias("code"))
    return l.withColumn("source", F.col("code") & contains_any(F.col("low"), _lower(SOURCES))).withColumn("sink", F.col("code") & contains_any(F.col("low"), _lower(SINKS) if strict else SINKS))


def proximity(lines: DataFrame, within: int = 5, strict: bool = False) -> DataFrame:
    """Rows (path, line_no, source_line, sink_line): each source line with the first sink line at most `within` lines away,
    earlier ones first; line_no is the line before the later of both, 1 at least."""
    w = Window.partitionBy("path").orderBy("line_no")
    at = F.when(F.col("sink"), F.col("line_no"))
    sink = F.coalesce(F.first(at, True).over(w.rangeBetween(-within, -1)), F.first(at, True).over(w.rangeBetween(1, within)))
    f = flagged(lines, strict).withColumn("sink_line", sink).filter("source AND sink_line IS NOT NULL")
    return f.select("path", F.greatest(F.greatest("line_no", "sink_line") - 1, F.lit(1)).alias("line_no"), F.col("line_no").alias("source_line"), "sink_line")


def line_anomalies(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (path, line_no, kind): bounds, transmute, pointer, any_cast, tainted_path and, in strict use, silent_except."""
    w = Window.partitionBy("path").orderBy("line_no")
    f = flagged(lines, strict).withColumn("any_source", contains_any(F.col("low"), _lower(SOURCES)))
    over = lambda c, a, b: F.coalesce(F.max(c).over(w.rowsBetween(a, b)), F.lit(False))
    low = F.col("low")
    f = f.withColumn("checked", over(contains_any(low, CHECKED), -4, -1)).withColumn("near_source", over(F.col("any_source"), -3, -1) | over(F.col("any_source"), 1, 2))
    f = f.withColumn("path_checked", over(contains_any(low, PATH_CHECKS), -5, 1)).withColumn("next", F.lead("t").over(w))
    kinds = [
        ("bounds", contains_any(low, INDEXED) & ~F.col("checked")),
        ("transmute", low.contains("transmute")),
        ("pointer", contains_any(low, ("*const ", "*mut ", "as *mut")) & F.col("near_source")),
        ("any_cast", F.col("ext").isin("ts", "tsx", "js", "jsx") & contains_any(low, ("as any", "@ts-ignore"))),
        ("tainted_path", F.col("any_source") & contains_any(low, _lower(FILE_CALLS) if strict else FILE_CALLS) & ~F.col("path_checked")),
    ]
    if strict:
        kinds.append(("silent_except", (F.col("ext") == "py") & F.col("t").rlike(r"^except\b.*:$") & ((F.col("next") == "pass") | F.col("next").startswith("#"))))
    hits = F.filter(F.array(*(F.when(on, F.lit(k)) for k, on in kinds)), lambda k: k.isNotNull())
    return f.filter("code").select("path", "line_no", F.explode(hits).alias("kind"))


def rated(anomalies: DataFrame) -> DataFrame:
    """Adds title, severity, confidence, cwe_id, owasp_category, exploitability, effort and risk of the anomaly scale."""
    col = lambda i: ladder(F.col("kind"), [(r[0], r[i]) for r in RATING], None)
    a = anomalies.select("*", F.concat(F.lit("[ZERO-DAY] "), col(1)).alias("title"), *(col(i).alias(n) for i, n in ((2, "severity"), (3, "confidence"), (4, "cwe_id"), (5, "owasp_category"))))
    s, c = F.col("severity"), F.col("confidence")
    return a.select(
        "*", ladder(c, [("High", 0.7), ("Medium", 0.5)], 0.3).alias("exploitability"),
        F.when(s.isin("Critical", "High"), "Hours").otherwise("Minutes").alias("effort"),
        ladder(s, [("Critical", 9.0), ("High", 7.0), ("Medium", 5.0), ("Low", 3.0)], 1.0).alias("zd_risk"),
    )


def is_signature(trimmed: Column, ext: Column) -> Column:
    low = F.lower(trimmed)
    paren = low.contains("(")
    js = ext.isin("js", "jsx", "ts", "tsx")
    return (
        (low.startswith("fn ") & paren)
        | (low.startswith("def ") & paren & low.endswith(":"))
        | (js & ((low.startswith("function ") & paren) | low.contains("= function(") | (low.contains("= (") & low.contains(") =>")) | (low.startswith("async function") & paren)))
        | ((ext == "go") & low.startswith("func ") & paren)
        | (contains_any(low, ("public ", "private ", "protected ", "internal ")) & paren & low.contains(")"))
        | ((ext == "php") & low.startswith("function ") & paren)
        | ((ext == "rb") & low.startswith("def ") & paren & low.endswith(")"))
    )


def function_name(trimmed: Column) -> Column:
    """Name after the first of `fn `, `function `, `def `, `func ` that is there with a parenthesis after it."""

    def after(k: str) -> Column:
        name = strip(F.regexp_extract(trimmed, rf"(?i)^.*?{k}([^(]*)\(", 1))
        return F.when(trimmed.rlike(rf"(?i)^.*?{k}[^(]*\("), strip(F.regexp_extract(name, r"^([^<]*)", 1)))

    return F.coalesce(*(after(k) for k in ("fn ", "function ", "def ", "func ")), F.lit("<anonymous>"))


def assigned_variable(line: Column) -> Column:
    """Variable that a line assigns: after a declaring keyword up to `=` or `:`, or a plain name before `=`."""
    t = strip(line)
    left = strip(F.regexp_extract(t, r"(?i)^(?:let mut |let |var |const |val |final )([^=]*)=", 1))
    declared = t.rlike(r"(?i)^(?:let mut |let |var |const |val |final )[^=]*=")
    typed = strip(F.regexp_extract(left, r"^([^:]*):", 1))
    plain = strip(F.regexp_extract(t, r"^([^=]*)=", 1))
    bare = t.contains("=") & ~t.rlike(r"^(if|for|while)") & ~t.rlike(r"[=!<>]=")
    return cascade(
        [(declared & left.contains(":"), typed), (declared & left.rlike(r"[{(]|^\["), F.lit(None).cast("string")), (declared, left), (bare & (plain != "") & ~plain.rlike(r"[ (]"), plain)],
        F.lit(None).cast("string"),
    )
