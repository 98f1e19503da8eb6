"""Command line over the operators: python -m findgrid.cli COMMAND PATH [options].

Rows are printed whole, as JSON lines, --limit of them (0: all); --output writes all rows or the whole report to a folder instead.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrid.functions import web
from findgrid.functions.shared import save_table
from findgrid.operators import anomaly, dependencies, diffs, flow, index, recon
from findgrid.operators import findings as fs
from findgrid.plans import reports, scan
from findgrid.sources import files as src

COMMANDS = ("init", "ask", "status", "review", "secrets", "deps", "sbom", "zeroday", "trace", "attack", "report", "pr", "ci", "plan", "redact")


def _rows(df: DataFrame, a: argparse.Namespace) -> None:
    """Prints or writes rows: nothing is cut."""
    if a.output:
        df.write.mode("overwrite").json(a.output)
        return
    for r in (df.limit(a.limit) if a.limit else df).toJSON().toLocalIterator():
        print(r)


def _lines(df: DataFrame, a: argparse.Namespace) -> None:
    """Prints or writes a document of rows (part, ord, line)."""
    lines = df.orderBy("part", "ord").select("line")
    if a.output:
        lines.write.mode("overwrite").text(a.output)
        return
    for r in lines.toLocalIterator():
        print(r["line"])


def _text(spark: SparkSession, text: str, a: argparse.Namespace) -> None:
    if a.output:
        reports.save_text(spark, text, a.output)
    else:
        print(text)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="findgrid")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path")
    p.add_argument("question", nargs="*")
    p.add_argument("--min-severity")
    p.add_argument("--min-confidence")
    p.add_argument("--max-findings", type=int, default=30, help="of review and secrets; 0: all")
    p.add_argument("--fail-on")
    p.add_argument("--top", type=int, default=10, help="chunks that ask shows")
    p.add_argument("--depth", type=int, default=4)
    p.add_argument("--format", choices=["rows", "json", "sarif", "markdown", "html", "executive", "spdx", "cyclonedx"])
    p.add_argument("--limit", type=int, default=50, help="rows printed; 0: all")
    p.add_argument("--output", help="folder to write to instead of printing")
    p.add_argument("--changed", help="JSON lines (path, patch) of a pull request")
    p.add_argument("--allow", help="JSON lines (fingerprint) of secrets that may stay")
    p.add_argument("--scanners", nargs="*", default=list(scan.SCANNERS), choices=scan.SCANNERS)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("findgrid").getOrCreate()
    f = src.walk(spark, a.path).withColumn("path", F.col("rel_path"))
    lines = src.lines(f)
    allowed = spark.read.schema("fingerprint string").json(a.allow) if a.allow else None
    found = lambda *only: scan.scan(spark, f, lines, only or tuple(a.scanners), allowed, " ".join(a.question))
    kept = index.Index(spark, f"{a.path.rstrip('/')}/.findgrid")
    if a.command in ("init", "ask", "status"):
        if a.command == "init" or kept.live().isEmpty():
            kept.update(f)
        if a.command == "status":
            _rows(kept.status(), a)
        if a.command == "ask":
            _rows(kept.contents(kept.search(" ".join(a.question), a.top)).orderBy(F.desc("score"), "path", "ord"), a)
    elif a.command in ("review", "secrets"):
        mine = found("rules" if a.command == "review" else "secrets")
        if a.format == "sarif":
            _lines(reports.sarif(mine), a)
        else:
            a.limit = 0  # the number of findings is its own option
            _rows(fs.top(mine, a.max_findings, a.min_severity, a.min_confidence).select("severity", "confidence", "title", "file_path", "line_number", "risk"), a)
    elif a.command == "deps":
        _rows(found("dependencies").drop("seq").orderBy(F.desc("risk"), "id"), a)
    elif a.command == "sbom":
        d = dependencies.parse_manifests(f)
        _text(spark, (dependencies.spdx(d) if a.format == "spdx" else dependencies.cyclonedx(d)).first()["document"], a)
    elif a.command == "zeroday":
        _rows(anomaly.rated(anomaly.line_anomalies(lines.filter(F.col("ext").isin(*src.ANOMALY_EXTS)))), a)
    elif a.command == "trace":
        paths, steps = flow.taint_paths(f.filter(F.col("ext").isin(*src.TRACE_EXTS)), a.depth, question=" ".join(a.question))
        chain = steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("step", "file", "line", "function", "action", "detail"))).alias("steps"))  # a path's few steps
        _rows(flow.dedup_paths(paths).join(chain, "path_id").drop("path_id").orderBy(F.desc("risk"), "id"), a)
    elif a.command == "attack":
        _rows(fs.chains(save_table(fs.deduped_all(found()), "findings")).orderBy(F.desc("risk")), a)
    elif a.command == "plan":
        _rows(recon.plan(recon.endpoints(lines)), a)
    elif a.command == "redact":
        _rows(f.select("path", web.redact_text(F.col("content")).alias("content")), a)
    else:
        every = save_table(fs.at_least(fs.deduped_all(found()), a.min_severity, a.min_confidence), "findings")  # reports read it several times
        if a.command == "ci":
            out = reports.ci_json(every, a.fail_on)
            _text(spark, out, a)
            return int('"failed": true' in out)
        if a.command == "pr":
            changed = spark.read.schema("path string, patch string").json(a.changed)
            _text(spark, reports.pull_request(every, diffs.split_findings(every, changed).filter("in_diff").drop("in_diff")), a)
        elif a.format == "sarif":
            _lines(reports.sarif_rules(every), a)
        elif a.format in ("rows", "json"):
            _rows(every.drop("seq").orderBy(F.desc("risk"), "id"), a)
        else:
            _text(spark, {"html": reports.html, "executive": reports.executive}.get(a.format, reports.markdown)(every), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
