"""All scanners over one project, as one findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrid.functions import scores
from findgrid.functions.shared import save_table
from findgrid.operators import anomaly, dependencies, flow, rules, secrets
from findgrid.operators import findings as fs
from findgrid.sources import files as src

SCANNERS = ("rules", "secrets", "anomalies", "taint", "dependencies")
_COLUMNS = ("source", "title", "severity", "confidence", "finding_type", "file_path", "line_number", "exploitability", "cwe_id", "owasp_category", "remediation")


def _standard(f: DataFrame, source: str, kind: str, remediation: str = "") -> DataFrame:
    fill = {"source": source, "finding_type": kind, "confidence": "Medium", "cwe_id": None, "owasp_category": None, "remediation": remediation}
    for name, value in fill.items():
        if name not in f.columns:
            f = f.withColumn(name, F.lit(value).cast("string"))
    if "exploitability" not in f.columns:
        f = f.withColumn("exploitability", scores.exploitability(F.col("severity")))
    return f.select(*(F.col(c).cast("long").alias(c) if c == "line_number" else F.col(c) for c in _COLUMNS))


def scan(spark: SparkSession, files: DataFrame, lines: DataFrame, scanners: tuple[str, ...] = SCANNERS, allowed: DataFrame | None = None, question: str = "") -> DataFrame:
    """Findings of files (path, rel_path, ext, content) and their lines by the scanners named, with id, seq and risk; duplicates are
    in. allowed: fingerprints of secrets that may stay."""
    out = []
    if "rules" in scanners:
        out.append(_standard(rules.match_rules(lines, rules.rule_table("review"), "security-review"), "security-review", "Vulnerability"))
    if "secrets" in scanners:
        found = secrets.match_secrets(lines, allowed).withColumn("cwe_id", F.lit("CWE-798")).withColumn("owasp_category", F.lit("A07:2021"))
        out.append(_standard(found, "secret-scanner", "Secret", "Revoke the secret and load it from a store."))
    if "anomalies" in scanners:
        found = anomaly.rated(anomaly.line_anomalies(lines.filter(F.col("ext").isin(*src.ANOMALY_EXTS))))
        out.append(_standard(found.withColumnsRenamed({"path": "file_path", "line_no": "line_number"}), "zero-day", "Vulnerability"))
    if "taint" in scanners:
        paths = flow.trace(files.filter(F.col("ext").isin(*src.TRACE_EXTS)), question=question)
        level = F.when(F.col("risk") >= 9, "Critical").when(F.col("risk") >= 7, "High").otherwise("Medium")
        found = paths.select(F.concat(F.lit("Untrusted input reaches "), "sink").alias("title"), level.alias("severity"), F.col("sink_path").alias("file_path"), F.col("sink_line").alias("line_number")).distinct()
        out.append(_standard(found.withColumn("cwe_id", scores.cwe_for_title(F.col("title"), F.lit("Vulnerability"))), "taint-trace", "Vulnerability", "Check or escape the input before it gets there."))
    if "dependencies" in scanners:
        found = dependencies.dependency_findings(dependencies.parse_manifests(files), dependencies.advisories(spark), lines)
        out.append(_standard(found.withColumn("confidence", F.lit("High")), "dependency-scanner", "Dependency", "Update the dependency."))
    # written once: what follows reads the findings several times, and the scanners' plans are long
    f = fs.with_risk(save_table(fs.merge_scanners(*out), "scanned"))
    return f.withColumn("id", F.concat_ws("|", "source", "title", "file_path", "line_number"))
