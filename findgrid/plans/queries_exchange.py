"""Queries over model replies, verdicts, proofs and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from findgrid.operators import configs
from findgrid.operators import exchange as ex
from findgrid.plans.queries_findings import CWE, SEV, _any, _q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TITLES = ("SQL Injection in login", "Weak random token", "CORS header", "Workflow race", "IDOR on orders", "Open port", "Private key in repo", "XSS")
_CLASSES = ("sqli", "Cross_Site-Scripting", "SSRF ", "rce", "idor", "session", "lfi", "other")


def _pick(values, col, by=1):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(col) / by) % len(values) + 1).cast("int"))


def proofs(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ev = F.array(F.lit("http://t.test/src/a.py:3"), F.when(k % 3 == 0, F.concat(F.lit("see src/app/f"), (k % 90).cast("string"), F.lit(".py:"), (k % 17 + 1).cast("string"))).otherwise("status 200"))
    return o.select(k.alias("seq"), _pick(_TITLES, "o_orderkey").alias("title"), _pick(("Critical", "High", "Medium", "Low", "Info"), "o_custkey").alias("severity"), ((k % 10) / 10).alias("confidence"), _pick(_CLASSES, "o_orderkey", 3).alias("raw_class"), F.concat(F.lit("GET /x/"), (k % 40).cast("string")).alias("endpoint"), ev.alias("evidence"))


_L = lambda v: "[" + ", ".join(map(_q, v)) + "]"
_P = f"WITH p AS (SELECT o_orderkey AS seq, {_L(_TITLES)}[o_orderkey % 8 + 1] AS title, {_L(('Critical', 'High', 'Medium', 'Low', 'Info'))}[o_custkey % 5 + 1] AS severity, (o_orderkey % 10)::DOUBLE / 10 AS confidence, {_L(_CLASSES)}[(o_orderkey // 3) % 8 + 1] AS raw_class, 'GET /x/' || (o_orderkey % 40) AS endpoint, CASE WHEN o_orderkey % 3 = 0 THEN 'src/app/f' || (o_orderkey % 90) || '.py' END AS file_path, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 17 + 1 ELSE 0 END AS line_number FROM orders)"
_CLASS = "CASE " + " ".join(f"WHEN translate(lower(trim(raw_class)), '_-', '') IN ({', '.join(map(_q, n))}) THEN {_q(c)}" for c, n in ex.CLASS_NAMES) + " END"
_TYPE = "CASE " + " ".join(f"WHEN {_any('lower(title)', w)} THEN {_q(k)}" for k, w in ex.TYPE_WORDS) + " ELSE 'Vulnerability' END"
_BAND = "CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END"


@query(f"""{_P} SELECT seq, title, severity, {_BAND} AS confidence, finding_type, round(confidence, 6) AS exploitability, 'endpoint: ' || endpoint AS usage, file_path, line_number, {CWE} AS cwe_id
FROM (SELECT *, CASE {_CLASS} WHEN 'sqli' THEN 'Injection' WHEN 'xss' THEN 'Injection' WHEN 'cmdi' THEN 'Injection' WHEN 'idor' THEN 'Authorization' WHEN 'auth' THEN 'Authentication' ELSE 'Vulnerability' END AS finding_type FROM p)""")
def proof_findings(spark, sf_dir):
    p = proofs(spark, sf_dir).withColumn("bug_class", ex.bug_class(F.col("raw_class")))
    f = ex.findings_of_proofs(p.withColumn("endpoint", F.concat("endpoint", F.lit("#"), F.col("seq").cast("string"))))
    parts = F.split("usage", "#")
    return f.select(parts[1].cast("long").alias("seq"), "title", "severity", "confidence", "finding_type", F.round("exploitability", 6).alias("exploitability"), parts[0].alias("usage"), "file_path", F.coalesce("line_number", F.lit(0).cast("long")).alias("line_number"), "cwe_id")


@query(f"{_P} SELECT raw_class, {_CLASS} AS bug_class, title, {_TYPE} AS finding_type, count(*)::BIGINT AS n FROM p GROUP BY ALL")
def class_and_type_names(spark, sf_dir):
    return proofs(spark, sf_dir).groupBy("raw_class", ex.bug_class(F.col("raw_class")).alias("bug_class"), "title", ex.finding_type_of(F.col("title")).alias("finding_type")).agg(F.count("*").alias("n"))


@query(f"{_P} SELECT seq FROM p WHERE {SEV.format('severity')} >= 3 AND confidence >= 0.5")
def report_limits(spark, sf_dir):
    return ex.report_filter(proofs(spark, sf_dir), "Medium", "Medium", proofs=True).select("seq")


@query(f"{_P} SELECT seq, endpoint, {_CLASS} AS bug_class, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.seq % 7 = 0 AND q.endpoint = p.endpoint AND q.raw_class = p.raw_class) THEN 'STILL VULNERABLE' ELSE 'FIXED' END AS verdict FROM p WHERE seq % 5 = 0 AND {_CLASS} IS NOT NULL")
def retest_verdicts(spark, sf_dir):
    p = proofs(spark, sf_dir).withColumn("bug_class", ex.bug_class(F.col("raw_class")))
    return ex.retest(p.filter("seq % 5 = 0 AND bug_class IS NOT NULL").select("seq", "endpoint", "bug_class"), p.filter("seq % 7 = 0"))


@query(f"""{_P}, v AS (SELECT seq // 15 AS b, seq % 15 AS i, seq % 2 = 0 AS r, CASE WHEN seq % 8 = 0 THEN 'Low' END AS s FROM p WHERE seq % 3 <> 1)
SELECT seq, coalesce(s, severity) AS severity FROM p LEFT JOIN v ON b = seq // 15 AND i = seq % 15 WHERE coalesce(r, true)""")
def verified_findings(spark, sf_dir):
    p = proofs(spark, sf_dir).select("seq", "severity", F.lit("Low").alias("confidence"))
    v = p.filter("seq % 3 <> 1").select(F.floor(F.col("seq") / 15).alias("batch"), (F.col("seq") % 15).alias("idx"), (F.col("seq") % 2 == 0).alias("is_real"), F.when(F.col("seq") % 8 == 0, "Low").alias("severity"), F.lit(None).cast("string").alias("confidence"))
    return ex.verified(p, v).select("seq", "severity")


_REPLY = 'Sure. {"findings": [{"title": "Leak %d", "severity": "high", "file_path": "a.py", "line_number": %d, "cwe": "cwe-89: x"}, {"title": "Other", "severity": "?"}]} done'


@query("""SELECT k, title, severity, file_path, line_number, cwe_id FROM (SELECT o_orderkey AS k, 'Leak ' || o_orderkey AS title, 'High' AS severity, 'a.py' AS file_path, o_orderkey AS line_number, 'CWE-89' AS cwe_id FROM orders UNION ALL SELECT o_orderkey, 'Other', 'Medium', NULL, 0, NULL FROM orders)""")
def findings_in_replies(spark, sf_dir):
    k = F.col("o_orderkey")
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.replace(F.lit(_REPLY), F.lit("%d"), k.cast("string")).alias("text"))
    return ex.findings_of_text(r).select("k", "title", "severity", "file_path", F.coalesce("line_number", F.lit(0).cast("long")).alias("line_number"), "cwe_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no_object' WHEN 1 THEN 'no_action' END AS error, CASE WHEN event_id % 4 = 2 THEN 'grep' END AS tool, event_id % 4 = 3 AS done, CASE WHEN event_id % 2 = 1 THEN 'boom' END AS message FROM events""")
def agent_turns(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("plain words", 'x {"thought": "t"} y', '{"tool_call": {"name": "grep"}}', '{"done": true}'))), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.when(F.col("event_id") % 2 == 1, F.lit('{"error": {"message": "boom"}}')).otherwise(F.lit('{"error": {"message": " "}}'))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ex.agent_turn(text).alias("t"), ex.provider_error(body).alias("message"))
    return e.select("event_id", "t.error", "t.tool", "t.done", "message")


@query("""SELECT doc_id, array_to_string(list_concat(l[1:1], ['new a', 'new b'], l[3:]), chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 3""")
def line_replacement(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.size(F.split("text", "\n")) >= 3)
    return d.select("doc_id", ex.replace_lines(F.col("text"), F.lit(2), F.lit(2), F.lit("new a\nnew b")).alias("text"))


@query()
def packed_queries(spark, sf_dir):
    """Context for two questions: the ten best documents of each, packed together."""
    from findgrid.operators import search

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = None
    for q, text in enumerate(("that reti ouan", "license thand")):
        best = search.search(d, "doc_id", "text", "source", text).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long")).withColumn("query", F.lit(q).cast("long"))
        out = best if out is None else out.unionByName(best)
    sized = out.join(d.select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id")
    return ex.pack_queries(sized.select("query", "rank", F.col("doc_id").cast("string").alias("chunk"), "bytes"))


@query("SELECT focus FROM (VALUES ('a'), ('b'), ('c')) v(focus) WHERE focus <> 'b'")
def resumed_missions(spark, sf_dir):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "focus string")
    return ex.missions_to_resume(m, m.filter("focus = 'b'"))


_RUNS = {"sev": ("high", "info", "Bogus", "Critical"), "conf": ("low", "sure", "HIGH"), "cls": ("sqli", "Cross-Site-Scripting", "other"), "live": ("true", "false", "null"), "login": ("form", "email", "sso"), "rule": ("url_path", "color")}
_RUN_BY = {"sev": 1, "conf": 4, "cls": 12, "live": 2, "login": 3, "rule": 5}
_RUN_JSON = '{"vuln_classes": ["%s", "ssrf"], "exploit": %s, "authentication": {"login_type": "%s"}, "rules": {"avoid": [{"type": "%s", "value": "x"}]}, "report": {"min_severity": "%s", "min_confidence": "%s"}}'


@query(f"""WITH v AS (SELECT o_orderkey AS k, {", ".join(f"[{', '.join(map(_q, _RUNS[c]))}][(o_orderkey // {by}) % {len(_RUNS[c])} + 1] AS {c}" for c, by in _RUN_BY.items())} FROM orders),
e AS (SELECT *, (sev IN ('info', 'Bogus'))::INT + (conf = 'sure')::INT + (login = 'sso')::INT + (rule = 'color')::INT AS n FROM v)
SELECT k, n = 0 AS valid, n::BIGINT AS n_errors, ((cls = 'other')::INT + (login = 'email')::INT)::BIGINT AS n_warnings, CASE cls WHEN 'sqli' THEN 'sqli,' WHEN 'other' THEN '' ELSE 'xss,' END || 'ssrf' AS classes, live <> 'false' AS live FROM e""")
def run_configs(spark, sf_dir):
    """A configuration file of a run for each order, checked."""
    field = {c: _pick(_RUNS[c], "o_orderkey", by) for c, by in _RUN_BY.items()}
    text = F.format_string(_RUN_JSON, *(field[c] for c in ("cls", "live", "login", "rule", "sev", "conf")))
    r = configs.checked(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("path"), text.alias("text")))
    return r.select(F.col("path").alias("k"), "valid", F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"), F.array_join("classes", ",").alias("classes"), "live")
