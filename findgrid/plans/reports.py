"""Documents for people and tools: SARIF as rows, Markdown, HTML and JSON from counts and the riskiest rows."""

from __future__ import annotations

import json
from html import escape as html_text

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrid.functions import scores
from findgrid.functions.shared import in_order, save_table
from findgrid.operators import findings as fs

# Fixed value: where the format is published.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def sarif(f: DataFrame, tool: str = "findgrid") -> DataFrame:
    """Rows (part, ord, line) of a SARIF 2.1.0 document with a result for every finding: written as text in the order of part and ord
    (`.orderBy("part", "ord").select("line").write.text`) they are the document."""
    loc = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.coalesce("cwe_id", "title").alias("ruleId"), scores.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(loc).alias("locations"))
    results = in_order(f.select("id", F.to_json(result).alias("r")), "id", "r", number="ord")
    results = results.select(F.lit(1).alias("part"), "ord", F.concat(F.when(F.col("ord") == 1, "").otherwise(","), "r").alias("line"))
    head = json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool}}, "results": []}]})
    ends = f.sparkSession.createDataFrame([(0, 0, head[:-4]), (2, 0, head[-4:])], "part int, ord long, line string")
    return ends.unionByName(results)


def sarif_with_rules(f: DataFrame, tool: str = "findgrid") -> DataFrame:
    """Properties of the results of the other shape: rule ids by weakness class, with a help anchor, the risk category and the confidence as properties."""
    rule = scores.report_class(F.col("cwe_id"), F.col("finding_type"))
    slug = F.regexp_replace(F.lower(rule), r"[^a-z0-9]+", "-")
    properties = F.struct(F.col("owasp_category").alias("owasp"), F.lower("confidence").alias("confidence"), F.array(F.concat(F.lit("external/owasp/"), F.lower("owasp_category"))).alias("tags"))
    out = F.struct(rule.alias("ruleId"), scores.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.concat(F.lit("#"), slug).alias("helpUri"), properties.alias("properties"))
    return f.select("id", F.to_json(out).alias("line"))


def sarif_rules(f: DataFrame, rule: Column | None = None, tool: str = "findgrid", by: str = "id", run: dict | None = None) -> DataFrame:
    """Rows (part, ord, line), in the order of part and ord, of a SARIF 2.1.0 document with a rules table: a rule for each value of
    `rule` (by default the weakness class), in the order of its first finding, with that one's risk category as a tag; results point
    at it by ruleIndex. A run without findings declares one rule. run: further properties."""
    rule = scores.report_class(F.col("cwe_id"), F.col("finding_type")) if rule is None else rule
    numbered = save_table(in_order(f.withColumn("_rule", rule), by), "results")
    first = numbered.groupBy("_rule").agg(F.min("_no").alias("_first"), F.min_by("owasp_category", "_no").alias("_owasp"))
    rules = save_table(in_order(first, "_first", number="_index").withColumn("_index", F.col("_index") - 1), "rules")
    tag = F.when(F.col("_owasp").isNotNull(), F.concat(F.lit("external/owasp/"), F.lower("_owasp")))
    shape = F.struct(F.col("_rule").alias("id"), F.struct(F.col("_rule").alias("text")).alias("shortDescription"), F.struct(F.array_compact(F.array(F.lit("security"), tag)).alias("tags")).alias("properties"))
    region = F.when(F.col("line_number").isNotNull(), F.struct(F.col("line_number").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.coalesce("file_path", F.lit("")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    advice = F.when(F.col("remediation") != "", F.concat(F.lit("\n\n**Remediation:** "), F.col("remediation"))) if "remediation" in f.columns else F.lit(None)
    text = F.concat(F.col("description") if "description" in f.columns else F.col("title"), F.coalesce(advice, F.lit("")))
    result = F.struct(F.col("_rule").alias("ruleId"), F.col("_index").alias("ruleIndex"), scores.sarif_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("id").alias("primaryLocationLineHash")).alias("partialFingerprints"))
    comma = F.when(F.col("ord") == 1, "").otherwise(",")
    lines = rules.select(F.lit(1).alias("part"), (F.col("_index") + 1).alias("ord"), F.to_json(shape).alias("line"))
    lines = lines.unionByName(numbered.join(rules.select("_rule", "_index"), "_rule").select(F.lit(3).alias("part"), F.col("_no").alias("ord"), F.to_json(result).alias("line")))
    lines = lines.withColumn("line", F.concat(comma, "line"))
    n = numbered.count()
    clean = json.dumps({"id": f"{tool}/clean", "shortDescription": {"text": "No findings"}})
    document = {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": ["RULES"]}}, "results": ["RESULTS"], "columnKind": "utf16CodeUnits", "properties": {"totalFindings": n} | (run or {})}]}
    head, rest = json.dumps(document).split('"RULES"')
    middle, tail = rest.split('"RESULTS"')
    fixed = [(0, 0, head), (2, 0, middle), (4, 0, tail), *([(1, 0, clean)] if not n else [])]
    return f.sparkSession.createDataFrame(fixed, "part int, ord long, line string").unionByName(lines)


def grade(score: float) -> str:
    return "good" if score >= 80 else "fair" if score >= 50 else "poor"


def markdown(f: DataFrame, title: str = "Findings", rows: int = 15) -> str:
    """A table of the riskiest rows under counts by severity; pipes in cells are escaped."""
    counts = {r["severity"]: r["n"] for r in fs.summary(f, "severity").collect()}
    score = f.agg(scores.security_score(F.col("severity"), F.col("exploitability"), F.col("business_impact")).alias("s")).first()["s"]
    cell = lambda x: str(x if x is not None else "").replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", f"Security score: {score:.0f} ({grade(score)})", "", ", ".join(f"{s}: {counts.get(s, 0)}" for s in ("Critical", "High", "Medium", "Low", "Info")), "", "| Severity | Title | Place | Risk |", "|-|-|-|-|"]
    for r in fs.top(f.withColumn("seq", F.col("id")), rows).collect():
        out.append(f"| {r['severity']} | {cell(r['title'])} | {cell(r['file_path'])}:{cell(r['line_number'])} | {r['risk']:.1f} |")
    return "\n".join(out)


def ci_json(f: DataFrame, fail_on: str | None = None) -> str:
    """Counts by scanner, totals and the gate's verdict."""
    g = fs.gate(f, fail_on).first()
    return json.dumps({"steps": [r.asDict() for r in fs.step_table(f).orderBy("source").collect()], "failing": g["n"], "failed": g["fails"]}, sort_keys=True)


def executive(f: DataFrame, title: str = "Summary") -> str:
    """Score, counts by severity and type, and the three riskiest issues, without places."""
    score = f.agg(scores.security_score(F.col("severity"), F.col("exploitability"), F.col("business_impact")).alias("s")).first()["s"]
    counts = {r["severity"]: r["n"] for r in fs.summary(f, "severity").collect()}
    kinds = fs.summary(f, "finding_type").orderBy(F.desc("n"), "finding_type").limit(5).collect()
    out = [f"# {title}", "", f"Security score: {score:.0f} of 100 ({grade(score)})", ""]
    out += [f"* {s}: {counts.get(s, 0)}" for s in ("Critical", "High", "Medium", "Low", "Info")]
    out += ["", "Most frequent kinds: " + ", ".join(f"{r['finding_type']} ({r['n']})" for r in kinds), "", "Riskiest:"]
    best = f.groupBy("title").agg(F.max("risk").alias("risk"), F.count("*").alias("n")).orderBy(F.desc("risk"), "title").limit(3)
    out += [f"1. {r['title']} ({r['n']} places, risk {r['risk']:.1f})" for r in best.collect()]
    return "\n".join(out)


def html(f: DataFrame, title: str = "Findings", rows: int = 100) -> str:
    """A page with the counts and a table of the riskiest rows; all text is escaped."""
    cell = lambda x: html_text(str(x if x is not None else ""))
    counts = {r["severity"]: r["n"] for r in fs.summary(f, "severity").collect()}
    score = f.agg(scores.security_score(F.col("severity"), F.col("exploitability"), F.col("business_impact")).alias("s")).first()["s"]
    body = "".join(f"<tr class=\"{cell(r['severity']).lower()}\"><td>{cell(r['severity'])}</td><td>{cell(r['title'])}</td><td>{cell(r['file_path'])}:{cell(r['line_number'])}</td><td>{r['risk']:.1f}</td></tr>" for r in fs.top(f.withColumn("seq", F.col("id")), rows).collect())
    sums = "".join(f"<li>{s}: {counts.get(s, 0)}</li>" for s in ("Critical", "High", "Medium", "Low", "Info"))
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1><p>Security score: {score:.0f} ({grade(score)})</p><ul>{sums}</ul><table><tr><th>Severity</th><th>Title</th><th>Place</th><th>Risk</th></tr>{body}</table></body></html>"


def pull_request(f: DataFrame, new: DataFrame, rows: int = 15) -> str:
    """Counts of new and earlier findings, the riskiest new ones, and what to do about the first five."""
    n, total = new.count(), f.count()
    cell = lambda x: str(x if x is not None else "").replace("|", "\\|").replace("\n", " ")
    top = fs.top(new.withColumn("seq", F.col("id")), rows).collect()
    out = [f"## {n} new findings, {total - n} from before", "", "| Severity | Title | Place |", "|-|-|-|"]
    out += [f"| {r['severity']} | {cell(r['title'])} | {cell(r['file_path'])}:{cell(r['line_number'])} |" for r in top]
    fixes = [(r["title"], r.asDict().get("remediation")) for r in top if r.asDict().get("remediation")][:5]
    return "\n".join([*out, *(["", "### Fixes", *(f"* {cell(t)}: {cell(x)}" for t, x in fixes)] if fixes else [])])


def save_text(spark, text: str, path: str) -> None:
    """A rendered report as one text file in a folder that Spark reaches."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
