"""Rows that come from models and live checks: free text to findings, verdicts, proofs, sessions. The model and the check are
the caller's; nothing here calls one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrid.functions import scores
from findgrid.functions.scores import cascade, contains_any, ladder
from findgrid.sources.files import split_lines

BATCH = 15
_FINDING = "struct<title: string, description: string, severity: string, confidence: string, file_path: string, line_number: long, cwe: string>"
# Words by type and names of classes.
TYPE_WORDS = (
    ("Injection", ("sql", "inject", "xss", "command", "template", "ldap", "ssrf")), ("Authentication", ("auth", "login", "session", "jwt", "mfa", "otp")),
    ("Authorization", ("access control", "authorization", "idor", "privilege", "permission")), ("Secret", ("secret", "credential", "api key", "api_key", "token", "private key", "aws ", " key")),
    ("Cryptography", ("crypto", "hash", "encrypt", "random", "md5", "sha1", "tls")), ("Misconfiguration", ("misconfig", "cors", "header", "debug", "cookie")), ("BusinessLogic", ("logic", "race", "business", "workflow")),
)
CLASS_NAMES = (
    ("sqli", ("sqli", "sqlinjection", "injection")), ("xss", ("xss", "crosssitescripting")), ("ssrf", ("ssrf", "server siderequestforgery")), ("cmdi", ("cmdi", "commandinjection", "rce")),
    ("idor", ("idor", "insecuredirectobjectreference", "objectenumeration")), ("auth", ("auth", "authentication", "session")), ("path-traversal", ("pathtraversal", "path", "traversal", "lfi")),
)
STAGES = ("planned", "swept", "agents_done", "complete")
ANCHOR = r"(?i)\b((?:[\w-]+/)+[\w.-]+\.(?:rs|py|js|ts|tsx|jsx|go|java|rb|php|c|h|cpp|hpp|cs|sh|kt|swift|sql|yaml|yml|toml|json))\s*:\s*(\d+)\b"


def findings_of_text(replies: DataFrame, text: str = "text", need_path: bool = False) -> DataFrame:
    """Findings in free text: the object that begins with {"findings", to the last brace, else the outermost array."""
    obj = F.regexp_extract(text, r'(?s)(\{\s*"findings".*\})', 1)
    arr = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    rows = F.coalesce(F.when(obj != "", F.from_json(obj, f"struct<findings: array<{_FINDING}>>")["findings"]), F.when(arr != "", F.from_json(arr, f"array<{_FINDING}>")))
    got = replies.select(*[c for c in replies.columns if c != text], F.explode(rows).alias("f")).select("*", "f.*").drop("f")
    got = got.withColumn("severity", scores.parse_severity(F.col("severity"), "Medium")).withColumn("cwe_id", scores.normalise_cwe(F.col("cwe"))).drop("cwe")
    return got.filter("file_path IS NOT NULL") if need_path else got


def merge_new(known: DataFrame, more: DataFrame) -> DataFrame:
    """known, and the rows of more whose (title, file_path) it lacks."""
    k = known.select(F.col("title").alias("_t"), F.col("file_path").alias("_p")).distinct()
    return known.unionByName(more.join(k, (F.col("title") == F.col("_t")) & F.col("file_path").eqNullSafe(F.col("_p")), "left_anti"), allowMissingColumns=True)


def verified(f: DataFrame, verdicts: DataFrame) -> DataFrame:
    """f (with seq) after verdicts (batch, idx, is_real, severity, confidence): real ones stay with what was overridden, false ones
    go, those without a verdict stay. Batches are of 15 rows by seq."""
    rn = F.col("seq") if dict(f.dtypes)["seq"] in ("int", "bigint") else F.row_number().over(Window.orderBy("seq")) - 1
    b = f.withColumn("_n", rn).withColumn("_b", F.floor(F.col("_n") / BATCH)).withColumn("_i", F.col("_n") % BATCH)
    v = verdicts.select(F.col("batch").alias("_b"), F.col("idx").alias("_i"), F.coalesce("is_real", F.lit(False)).alias("_r"), F.col("severity").alias("_s"), F.col("confidence").alias("_c"))
    j = b.join(v, ["_b", "_i"], "left").filter("coalesce(_r, true)")
    return j.withColumn("severity", F.coalesce("_s", "severity")).withColumn("confidence", F.coalesce("_c", "confidence")).select(*f.columns)


def verify(f: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """f as the model's verdicts leave it; without a model f itself."""
    return verified(f, model(f)) if model else f


def finding_type_of(title: Column) -> Column:
    t = F.lower(title)
    return cascade([(contains_any(t, words), kind) for kind, words in TYPE_WORDS], "Vulnerability")


def finding_type_named(text: Column) -> Column:
    names = [("secret", "Secret"), ("misconfiguration", "Misconfiguration"), ("dependency", "Dependency"), ("business-logic", "BusinessLogic"), ("business_logic", "BusinessLogic"), ("businesslogic", "BusinessLogic"), ("authentication", "Authentication"), ("authorization", "Authorization"), ("injection", "Injection"), ("cryptography", "Cryptography")]
    return ladder(F.lower(text), names, "Vulnerability")


def bug_class(text: Column) -> Column:
    """Class by a tolerant name; one alias has a blank and so can match only if the input has it: compat."""
    x = F.translate(F.lower(F.trim(text)), "_-", "")
    return cascade([(x.isin(*names), c) for c, names in CLASS_NAMES], None)


def code_anchor(evidence: Column) -> Column:
    """struct(path, line) of the first dir/file.ext:NN in evidence lines that are neither URLs nor absolute paths."""
    ok = F.filter(evidence, lambda x: ~x.contains("://") & ~x.startswith("/") & x.rlike(ANCHOR))
    first = F.get(ok, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.regexp_replace(F.regexp_extract(first, ANCHOR, 1), r"^(\./)+", "").alias("path"), F.regexp_extract(first, ANCHOR, 2).cast("long").alias("line")))


def confidence_band(p: Column) -> Column:
    return F.when(p >= 0.7, "High").when(p >= 0.5, "Medium").otherwise("Low")


def findings_of_proofs(proofs: DataFrame) -> DataFrame:
    """Proofs (bug_class, title, severity, confidence, endpoint, evidence) as findings."""
    kind = ladder(F.col("bug_class"), [("sqli", "Injection"), ("xss", "Injection"), ("cmdi", "Injection"), ("idor", "Authorization"), ("auth", "Authentication")], "Vulnerability")
    p = proofs.withColumn("finding_type", kind).withColumn("_a", code_anchor(F.col("evidence")))
    return p.select("title", "severity", confidence_band(F.col("confidence")).alias("confidence"), "finding_type", F.col("confidence").alias("exploitability"), F.concat(F.lit("endpoint: "), "endpoint").alias("usage"), F.col("_a.path").alias("file_path"), F.col("_a.line").alias("line_number"), scores.cwe_for_title(F.col("title"), F.col("finding_type")).alias("cwe_id"), F.lit("pentest").alias("source"))


def report_filter(rows: DataFrame, min_severity: str | None, min_confidence: str | None, proofs: bool = False) -> DataFrame:
    """Findings, or with proofs=True proofs by the band of their confidence, that a report's limits keep."""
    conf = confidence_band(F.col("confidence")) if proofs else F.col("confidence")
    on = F.lit(True)
    if min_severity:
        on &= scores.severity_score(F.col("severity")) >= scores.severity_score(F.lit(min_severity))
    if min_confidence:
        on &= scores.confidence_score(conf) >= scores.confidence_score(F.lit(min_confidence))
    return rows.filter(on)


def retest(before: DataFrame, after: DataFrame) -> DataFrame:
    """before (endpoint, bug_class, title) with verdict: STILL VULNERABLE if a fresh proof of the class is there, else FIXED."""
    a = after.select("endpoint", "bug_class").distinct().withColumn("_hit", F.lit(True))
    return before.join(a, ["endpoint", "bug_class"], "left").withColumn("verdict", F.when(F.col("_hit"), "STILL VULNERABLE").otherwise("FIXED")).drop("_hit")


def retest_finding(title: str, proofs: DataFrame, fresh: DataFrame) -> DataFrame:
    """proofs (title, endpoint, bug_class) of the finding of that title, in any case, with their verdict."""
    return retest(proofs.filter(F.lower("title") == title.lower()), fresh)


def stage_reached(stage: Column, other: str) -> Column:
    return ladder(stage, [(s, i) for i, s in enumerate(STAGES)], None) >= STAGES.index(other)


def missions_to_resume(missions: DataFrame, done: DataFrame) -> DataFrame:
    return missions.join(done.select("focus").distinct(), "focus", "left_anti")


def provider_error(body: Column) -> Column:
    """$.error.message of a reply, null if blank."""
    m = F.get_json_object(body, "$.error.message")
    return F.when(F.trim(m) != "", m)


def agent_turn(text: Column) -> Column:
    """struct(thought, tool, done, error) of a reply: the object from the first { to the last }, with an error code where there is
    none, it can't be read, or it names neither a tool nor an end."""
    raw = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    t = F.from_json(raw, "struct<thought: string, tool_call: struct<name: string>, done: boolean>")
    error = cascade([(raw == "", "no_object"), (F.try_parse_json(raw).isNull(), "bad_json"), (t["tool_call"]["name"].isNull() & ~F.coalesce(t["done"], F.lit(False)), "no_action")], F.lit(None).cast("string"))
    return F.struct(t["thought"].alias("thought"), t["tool_call"]["name"].alias("tool"), F.coalesce(t["done"], F.lit(False)).alias("done"), error.alias("error"))


def replace_lines(content: Column, first: Column, last: Column, new: Column) -> Column:
    """content with lines first..last (1-based) replaced by the text new."""
    l = F.split(content, "\n")
    return F.array_join(F.concat(F.slice(l, 1, F.greatest(first - 1, F.lit(0))), F.split(new, "\n"), F.slice(l, last + 1, F.greatest(F.size(l) - last, F.lit(0)))), "\n")


def guarded_replacement(content: Column, first: Column, last: Column, new: Column, slack: int = 4) -> Column:
    """replace_lines(), null if the new text has over `slack` lines more or less than those it replaces."""
    n = lambda x: F.size(split_lines(x))
    had = F.least(last, n(content)) - first + 1
    return F.when(F.abs(n(new) - had) <= slack, replace_lines(content, first, last, new))


def history(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, history, turns): the turns (conv_id, turn, role, text) of a conversation as one text, each whole."""
    g = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("l")))).alias("x"), F.count("*").alias("turns"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("history"), "turns")


def newest_message(messages: DataFrame, thread: str, order: str, subject: str | None = None, sender: str | None = None) -> DataFrame:
    """The newest message of each thread whose subject and sender contain the given words, in any case."""
    for column, word in (("subject", subject), ("sender", sender)):
        if word:
            messages = messages.filter(F.contains(F.lower(column), F.lit(word.lower())))
    last = messages.groupBy(thread).agg(F.max(order).alias(order))
    return messages.join(last, [thread, order])


def pack_queries(ranked: DataFrame, budget: int = 20_000) -> DataFrame:
    """Context of several queries: rows (query, rank, chunk, bytes) taken in order of query and rank. A chunk counts once; one that
    overflows ends its query only, so later queries may add smaller ones. A fold over a report's few rows."""
    item = F.struct("query", "rank", "chunk", "bytes")
    rows = ranked.agg(F.array_sort(F.collect_list(item)).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("ended"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        skip = (a["ended"] == x["query"]) | F.array_contains(a["seen"], x["chunk"])
        over = a["used"] + x["bytes"] > budget
        seen = F.when(skip, a["seen"]).otherwise(F.concat(a["seen"], F.array(x["chunk"])))
        return F.struct(F.when(skip | over, a["used"]).otherwise(a["used"] + x["bytes"]).alias("used"), F.when(~skip & over, x["query"].cast("long")).otherwise(a["ended"]).alias("ended"), seen.alias("seen"), F.when(skip | over, a["taken"]).otherwise(F.concat(a["taken"], F.array(x["chunk"]))).alias("taken"))

    return rows.select(F.aggregate("l", start, step).alias("a")).select(F.explode("a.taken").alias("chunk"))
