"""Queries of the rule scan and of findings tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrid.functions import scores
from findgrid.functions.shared import save_table
from findgrid.operators import findings as fs
from findgrid.operators import rules
from findgrid.plans.fixtures import CODE_SQL, code_lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(value: str, steps, default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in steps) + f" ELSE {default} END"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


SEV = "CASE {0} WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 END"
CONF = "CASE {0} WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 END"
_EXPL = "CASE severity WHEN 'Critical' THEN 0.8 WHEN 'High' THEN 0.6 WHEN 'Medium' THEN 0.4 WHEN 'Low' THEN 0.2 ELSE 0.1 END::DOUBLE"


def _holds(w) -> str:
    if len(w) > 1 and isinstance(w[-1], tuple):
        return f"contains(lower(title), {_q(w[0])}) AND {_any('lower(title)', w[-1])}"
    return _any("lower(title)", w)


CWE = "CASE " + " ".join(f"WHEN {_holds(w)} THEN '{c}'" for w, c in scores.CWE_BY_TITLE) + " ELSE " + _case("finding_type", scores.CWE_BY_TYPE, "NULL") + " END"


def _scan_sql(table, source: str, comments: bool) -> str:
    skip = r"AND trim(line) <> '' AND NOT regexp_matches(trim(line), '^(//|#|/\*|\*)')" if comments else ""
    one = []
    for r in table:
        on = f"regexp_matches(line, {_q(r.pattern)})" + (f" AND ext IN ({', '.join(map(_q, r.exts))})" if r.exts else "") + (f" AND NOT regexp_matches(line, {_q(r.unless)})" if r.unless else "")
        one.append(f"SELECT path AS file_path, line_no AS line_number, {_q(r.title)} AS title, {_q(r.severity)} AS severity, {_q(r.confidence)} AS confidence, {_q(r.owasp)} AS owasp_category, {_q(r.finding_type)} AS finding_type, {_q(source)} AS source FROM code WHERE {on} {skip}")
    return " UNION ALL ".join(one)


def _impact() -> str:
    base = _case("finding_type", scores.IMPACT_BY_TYPE, "NULL") + "::DOUBLE"
    p = "lower(file_path)"
    x = f"CASE WHEN {_any(p, scores.IMPACT_UP_15)} THEN least({base} + 0.15::DOUBLE, 1) ELSE {base} END"
    x = f"CASE WHEN {_any(p, scores.IMPACT_UP_10)} THEN least({x} + 0.1::DOUBLE, 1) ELSE {x} END"
    return f"CASE WHEN {_any(p, scores.IMPACT_DOWN_20)} THEN greatest({x} - 0.2::DOUBLE, 0.1) ELSE {x} END"


#: CTEs code, review, secrets, found (both, with impact and risk).
FOUND_SQL = f"""{CODE_SQL}, review AS ({_scan_sql(rules.REVIEW_RULES, "security-review", True)}),
secrets AS ({_scan_sql(rules.SECRET_RULES, "secret-scanner", False)}),
found AS (SELECT *, (sev * 2.0::DOUBLE + conf * 0.5::DOUBLE + exploitability * 2.0::DOUBLE + business_impact * 2.0::DOUBLE) / 15.0::DOUBLE * 10.0::DOUBLE AS raw_risk, least(greatest(raw_risk, 0), 10) AS risk,
    concat_ws('|', source, title, file_path, line_number) AS id
  FROM (SELECT *, {SEV.format("severity")} AS sev, {CONF.format("confidence")} AS conf, {_EXPL} AS exploitability, {_impact()} AS business_impact, {CWE} AS cwe_id
        FROM (SELECT * FROM review UNION ALL SELECT * FROM secrets)))"""


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rules(code_lines(spark, sf_dir), rules.rule_table("review"), "security-review")


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rules(code_lines(spark, sf_dir), rules.rule_table("secrets"), "secret-scanner", skip_comments=False)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fs.with_risk(review_findings(spark, sf_dir).unionByName(secret_findings(spark, sf_dir)))
    return f.withColumn("id", F.concat_ws("|", "source", "title", "file_path", "line_number"))


r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


@query(f"{FOUND_SQL} SELECT severity, count(*)::BIGINT AS n, round(avg(risk), 6) AS avg_risk FROM found WHERE source = 'security-review' GROUP BY severity")
def rule_scan_severity(spark, sf_dir):
    return fs.summary(fs.with_risk(review_findings(spark, sf_dir)), "severity").select("severity", "n", r6("avg_risk").alias("avg_risk"))


@query(f"{FOUND_SQL} SELECT file_path, line_number, title, severity, confidence, owasp_category, cwe_id, round(exploitability, 6) AS exploitability, round(business_impact, 6) AS business_impact, round(risk, 6) AS risk FROM found WHERE source = 'security-review'")
def rule_scan(spark, sf_dir):
    f = fs.with_risk(review_findings(spark, sf_dir))
    return f.select("file_path", "line_number", "title", "severity", "confidence", "owasp_category", "cwe_id", r6("exploitability").alias("exploitability"), r6("business_impact").alias("business_impact"), r6("risk").alias("risk"))


@query(f"{FOUND_SQL} SELECT file_path, line_number, title, severity, cwe_id FROM found WHERE source = 'secret-scanner'")
def secret_scan(spark, sf_dir):
    return secret_findings(spark, sf_dir).select("file_path", "line_number", "title", "severity", "cwe_id")


_TOKEN_RULE = rules.SECRET_RULES[6].pattern


@query(f"SELECT doc_id, i AS line_no, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, {_q(_TOKEN_RULE)})")
def secret_scan_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return d.filter(F.col("line").rlike(_TOKEN_RULE)).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(f"{FOUND_SQL} SELECT title, count(*)::BIGINT AS n FROM found WHERE {SEV.format('severity')} >= 4 AND {CONF.format('confidence')} >= 2 GROUP BY title")
def severity_confidence_filter(spark, sf_dir):
    return fs.at_least(found(spark, sf_dir), "High", "Medium").groupBy("title").agg(F.count("*").alias("n"))


@query(f"{FOUND_SQL} SELECT id, round(risk, 6) AS risk FROM found WHERE sev >= 3 ORDER BY found.risk DESC, id LIMIT 30")
def top_findings(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("seq", F.col("id"))
    return fs.top(f, 30, "Medium").select("id", r6("risk").alias("risk"))


@query(f"{FOUND_SQL} SELECT l AS level, count(*) FILTER (sev >= s)::BIGINT AS n, count(*) FILTER (sev >= s) > 0 AS fails FROM found, (VALUES ('critical', 5), ('high', 4), ('medium', 3), ('low', 2), ('info', 99), ('unknown', 99)) v(l, s) GROUP BY l")
def fail_gate(spark, sf_dir):
    f = found(spark, sf_dir)
    out = None
    for level in ("critical", "high", "medium", "low", "info", "unknown"):
        g = fs.gate(f, level).withColumn("level", F.lit(level))
        out = g if out is None else out.unionByName(g)
    return out


@query(f"{FOUND_SQL} SELECT id FROM found WHERE contains(file_path, 'auth/f1')")
def fix_selector(spark, sf_dir):
    return fs.select_for_fix(found(spark, sf_dir), "auth/f1").select("id")


@query(f"""{FOUND_SQL}, k AS (SELECT *, lower(title) AS bucket, {_any("lower(title)", scores.CREDENTIAL_WORDS)} AS cred FROM found)
SELECT file_path, line_number, title, round(risk, 6) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_number, bucket ORDER BY k.risk DESC, id) AS rn FROM k WHERE NOT cred) WHERE rn = 1""")
def dedup_plain(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("seq", F.xxhash64("id"))
    return fs.dedup(f.filter(~scores.is_credential_like(F.col("title")))).select("file_path", "line_number", "title", r6("risk").alias("risk"))


_SAME = "coalesce(list_position(list_transform(a, lambda e: e.t = x[1].t OR e.source <> x[1].source), true), 0)"
_ORDERED = f"""{FOUND_SQL}, k AS (SELECT *, lower(title) AS t, {_any("lower(title)", scores.CREDENTIAL_WORDS)} AS cred, CASE source WHEN 'security-review' THEN 0 ELSE 1 END AS scan FROM found)"""
_DEDUP = f"""{_ORDERED}, folded AS (SELECT file_path, line_number, list_reduce(list_transform(list({{'t': t, 'title': title, 'source': source, 'risk': risk, 'severity': severity, 'cwe_id': cwe_id}} ORDER BY scan, id), lambda x: [x]),
    lambda a, x: CASE WHEN {_SAME} = 0 THEN list_concat(a, x) ELSE list_transform(a, lambda e, i: CASE WHEN i = {_SAME} AND x[1].risk > e.risk THEN x[1] ELSE e END) END) AS l FROM k WHERE cred GROUP BY ALL),
dedup AS (SELECT file_path, line_number, title, source, risk, severity, cwe_id FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_number, t ORDER BY k.risk DESC, scan, id) AS rn FROM k WHERE NOT cred) WHERE rn = 1
    UNION ALL SELECT file_path, line_number, x.title, x.source, x.risk, x.severity, x.cwe_id FROM (SELECT file_path, line_number, unnest(l) AS x FROM folded))"""


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """found with seq: scanner, then place."""
    scan = F.when(F.col("source") == "security-review", 0).otherwise(1)
    return found(spark, sf_dir).withColumn("seq", F.struct(scan.alias("scan"), "id"))


@query(f"{_DEDUP} SELECT file_path, line_number, title, source, round(risk, 6) AS risk FROM dedup")
def dedup_findings(spark, sf_dir):
    return fs.dedup(arrived(spark, sf_dir)).select("file_path", "line_number", "title", "source", r6("risk").alias("risk"))


@query(f"{_DEDUP} SELECT count(*)::BIGINT AS n, round(sum(risk), 3) AS risk, count(DISTINCT file_path)::BIGINT AS files FROM dedup")
def merged_scanners(spark, sf_dir):
    """Findings of both scanners as merge_scanners() numbers them, deduplicated and ranked."""
    both = [fs.with_risk(x).withColumn("id", F.concat_ws("|", "source", "title", "file_path", "line_number")) for x in (review_findings(spark, sf_dir), secret_findings(spark, sf_dir))]
    return fs.merge_and_rank(fs.merge_scanners(*both)).agg(F.count("*").alias("n"), F.round(F.sum("risk"), 3).alias("risk"), F.count_distinct("file_path").alias("files"))


@query(f"""{_ORDERED}, o AS (SELECT *, first(source) OVER (PARTITION BY file_path, line_number, CASE WHEN cred THEN '' ELSE t END ORDER BY k.risk DESC, scan, id) AS s1,
row_number() OVER (PARTITION BY file_path, line_number, t, source ORDER BY k.risk DESC, scan, id) AS rs, row_number() OVER (PARTITION BY file_path, line_number, t ORDER BY k.risk DESC, scan, id) AS rn, cred AS c FROM k)
SELECT id FROM o WHERE CASE WHEN c THEN source = s1 AND rs = 1 ELSE rn = 1 END""")
def deduped_all(spark, sf_dir):
    return fs.deduped_all(arrived(spark, sf_dir)).select("id")


@query(f"""{_DEDUP} SELECT '[' || severity || '] ' || title || ' — ' || file_path || ':' || line_number || ' (CWE ' || coalesce(cwe_id, '-') || ')' AS line FROM dedup WHERE {SEV.format("severity")} >= 4""")
def scanner_feed(spark, sf_dir):
    return fs.feed_lines(fs.dedup(arrived(spark, sf_dir)), "high").select("line")


@query(f"{FOUND_SQL} SELECT source AS layer, id, row_number() OVER (PARTITION BY source ORDER BY found.risk DESC, id)::BIGINT AS place, count(*) OVER (PARTITION BY source)::BIGINT AS total FROM found")
def layer_order(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("layer", F.col("source")).withColumn("seq", F.col("id"))
    return fs.by_layer(f).select("layer", "id", F.col("place").cast("long").alias("place"), "total")


@query(f"""{_DEDUP}, s AS (SELECT source, severity FROM found UNION ALL SELECT 'total', severity FROM dedup) SELECT source, count(*)::BIGINT AS total, count(*) FILTER (severity = 'Critical')::BIGINT AS critical, count(*) FILTER (severity = 'High')::BIGINT AS high,
CASE WHEN count(*) FILTER (severity IN ('Critical', 'High')) > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM s GROUP BY source""")
def ci_totals(spark, sf_dir):
    return fs.ci_totals(arrived(spark, sf_dir)).select("source", "total", "critical", "high", "status")


@query(f"""{FOUND_SQL} SELECT source, count(*)::BIGINT AS total, count(*) FILTER (severity = 'Critical')::BIGINT AS critical, count(*) FILTER (severity = 'High')::BIGINT AS high,
count(*) FILTER (severity = 'Medium')::BIGINT AS medium, count(*) FILTER (severity = 'Low')::BIGINT AS low, count(*) FILTER (severity = 'Info')::BIGINT AS info,
CASE WHEN count(*) FILTER (sev >= 4) > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM found GROUP BY source""")
def ci_steps(spark, sf_dir):
    return fs.step_table(found(spark, sf_dir))


@query(f"""{FOUND_SQL} SELECT file_path, round(greatest(least(100 - sum({_case("severity", scores.SEVERITY_WEIGHT, "0.0")} * (exploitability + 0.5) * (business_impact + 0.5)), 100), 0), 6) AS score, count(*)::BIGINT AS n FROM found GROUP BY file_path""")
def security_score_by_file(spark, sf_dir):
    return found(spark, sf_dir).groupBy("file_path").agg(F.round(scores.security_score(F.col("severity"), F.col("exploitability"), F.col("business_impact")), 6).alias("score"), F.count("*").alias("n"))


@query(f"{FOUND_SQL} SELECT severity, finding_type, count(*)::BIGINT AS n FROM found GROUP BY ROLLUP (severity, finding_type)")
def severity_type_rollup(spark, sf_dir):
    return found(spark, sf_dir).rollup("severity", "finding_type").agg(F.count("*").alias("n"))


_FP = "concat_ws(':', file_path, line_number::VARCHAR, lower(title), severity, '')"


@query(f"{FOUND_SQL} SELECT DISTINCT {_FP} AS fingerprint FROM found EXCEPT SELECT {_FP} FROM found WHERE line_number % 3 <> 0")
def watch_new_findings(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("usage", F.lit(None).cast("string")).withColumn("fingerprint", fs.fingerprint())
    return fs.new_since(f, f.filter("line_number % 3 <> 0"))


def _chain_tags(side: str) -> str:
    return " UNION ALL ".join(f"SELECT {_q(r.name)} AS chain, {r.factor}::DOUBLE AS factor, * FROM found WHERE {_any('lower(title)', getattr(r, side))}" for r in fs.CHAIN_RULES)


@query(f"""{FOUND_SQL}, e AS ({_chain_tags("entry")}), t AS ({_chain_tags("target")})
SELECT e.chain, e.title AS entry_title, t.title AS target_title, round(max(least(10, (e.risk + t.risk) / 2 * e.factor * CASE WHEN e.file_path = t.file_path THEN 1.5::DOUBLE ELSE 1::DOUBLE END)), 6) AS risk
FROM e JOIN t ON e.chain = t.chain AND e.id <> t.id GROUP BY ALL""")
def attack_chains(spark, sf_dir):
    return fs.chains(found(spark, sf_dir)).select("chain", "entry_title", "target_title", r6("risk").alias("risk"))


@query(f"""{FOUND_SQL}, ends AS (SELECT file_path AS chain_id, file_path, min(line_number) AS lo, max(line_number) AS hi FROM found GROUP BY file_path HAVING count(*) > 2)
SELECT chain_id, line, between_title, step::BIGINT AS step FROM (SELECT chain_id, f.line_number AS line, f.title AS between_title, row_number() OVER (PARTITION BY chain_id ORDER BY {_any('lower(f.title)', fs.THEME)} DESC, f.line_number, f.title) AS step
FROM ends JOIN found f ON f.file_path = ends.file_path AND f.line_number > lo AND f.line_number < hi) WHERE step <= 3""")
def chain_intermediates(spark, sf_dir):
    f = save_table(found(spark, sf_dir).select("file_path", "line_number", "title"), "found")
    ends = f.groupBy("file_path").agg(F.min("line_number").alias("lo"), F.max("line_number").alias("hi"), F.count("*").alias("n")).filter("n > 2").withColumn("chain_id", F.col("file_path"))
    return fs.intermediates(ends, f, 5).select("chain_id", "line", "between_title", F.col("step").cast("long").alias("step"))


@query(f"""{FOUND_SQL} SELECT coalesce(cwe_id, title) AS rule_id, CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level, file_path AS uri, line_number AS start_line, title AS message FROM found""")
def sarif_results(spark, sf_dir):
    return found(spark, sf_dir).select(F.coalesce("cwe_id", "title").alias("rule_id"), scores.sarif_level(F.col("severity")).alias("level"), F.col("file_path").alias("uri"), F.col("line_number").alias("start_line"), F.col("title").alias("message"))


def _class_sql(test: str) -> str:
    h = lambda c: test.format(c)
    return f"CASE WHEN {h('CWE-79')} THEN 'xss' WHEN {h('CWE-89')} THEN 'injection' WHEN {h('CWE-78')} THEN 'cmdi' WHEN {h('CWE-918')} THEN 'ssrf' WHEN {h('CWE-22')} THEN 'path-traversal' WHEN {h('CWE-639')} OR {h('CWE-862')} THEN 'idor' ELSE CASE finding_type WHEN 'Secret' THEN 'secrets' WHEN 'Injection' THEN 'injection' ELSE 'general' END END"


@query(f"""{FOUND_SQL} SELECT {_class_sql("contains(cwe_id, '{0}')")} AS compat_class, {_class_sql("cwe_id = '{0}'")} AS strict_class, count(*)::BIGINT AS n FROM found GROUP BY ALL""")
def report_classes(spark, sf_dir):
    c, t = F.col("cwe_id"), F.col("finding_type")
    return found(spark, sf_dir).groupBy(scores.report_class(c, t).alias("compat_class"), scores.report_class(c, t, compat=False).alias("strict_class")).agg(F.count("*").alias("n"))


@query("""SELECT raw, nullif(regexp_extract(upper(trim(raw)), '^(?:CWE-)?([0-9]+)', 1), '') IS NOT NULL AS ok, 'CWE-' || nullif(regexp_extract(upper(trim(raw)), '^(?:CWE-)?([0-9]+)', 1), '') AS cwe,
CASE upper(trim(sev)) WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' WHEN 'LOW' THEN 'Low' WHEN 'INFO' THEN 'Info' ELSE 'Info' END AS severity, n
FROM (SELECT ['cwe-' || (p_partkey % 50) || ': x', (p_partkey % 50)::VARCHAR, 'CWE-', 'none', ''][p_partkey % 5 + 1] AS raw, ['critical', ' High', 'LOW ', 'info', '?'][p_size % 5 + 1] AS sev, count(*)::BIGINT AS n FROM part GROUP BY ALL)""")
def parse_ratings(spark, sf_dir):
    k = F.col("p_partkey") % 50
    raw = F.element_at(F.array(F.concat(F.lit("cwe-"), k.cast("string"), F.lit(": x")), k.cast("string"), F.lit("CWE-"), F.lit("none"), F.lit("")), (F.col("p_partkey") % 5 + 1).cast("int"))
    sev = F.element_at(F.array(*map(F.lit, ("critical", " High", "LOW ", "info", "?"))), F.col("p_size") % 5 + 1)
    g = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(raw.alias("raw"), sev.alias("s")).agg(F.count("*").alias("n"))
    cwe = scores.normalise_cwe(F.col("raw"))
    return g.select("raw", cwe.isNotNull().alias("ok"), cwe.alias("cwe"), scores.parse_severity(F.col("s"), "Info").alias("severity"), "n")


#: Changed files with a patch, one for each file: a hunk at line 3 that adds two lines and drops one.
_PATCH = "@@ -3,3 +3,4 @@ ctx\n same\n-gone\n+added one\n+added two\n rest\n@@ -20,1 +21,2 @@\n keep\n+tail"


@query(f"""{FOUND_SQL}, hit AS (SELECT *, contains(file_path, 'src/') AS patched FROM found)
SELECT id, NOT patched OR line_number IN (4, 5, 22) AS in_diff FROM hit""")
def split_by_diff(spark, sf_dir):
    from findgrid.operators import diffs

    f = save_table(found(spark, sf_dir).select("id", "file_path", "line_number"), "found")  # used four times
    changed = f.select(F.col("file_path").alias("path")).distinct().filter(F.col("path").contains("src/")).withColumn("patch", F.lit(_PATCH))
    return diffs.split_findings(f, changed).select("id", "in_diff")
