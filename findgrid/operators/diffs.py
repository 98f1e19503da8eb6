"""Unified diffs as rows: the lines a patch adds, and which findings lie on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def added_lines(changed: DataFrame) -> DataFrame:
    """Rows (path, line): new line numbers of the lines that patches (path, patch) add.

    A hunk starts the count at the number after its plus sign; context and added lines advance it. An added line whose text
    starts with ++ reads like a file header and advances nothing, as in the compat behaviour."""
    l = changed.filter("patch IS NOT NULL").select("path", F.posexplode(F.split("patch", "\n")).alias("i", "t"))
    w = Window.partitionBy("path").orderBy("i")
    head = F.col("t").startswith("@@")
    l = l.withColumn("hunk", F.sum(head.cast("int")).over(w)).withColumn("start", F.last(F.when(head, F.regexp_extract("t", r"\+([0-9]+)", 1).cast("long")), ignorenulls=True).over(w))
    file_head = F.col("t").startswith("+++") | F.col("t").startswith("---")
    counts = ~head & ~file_head & ~F.col("t").startswith("-") & ~F.col("t").startswith("\\")
    within = Window.partitionBy("path", "hunk").orderBy("i")
    l = l.filter("hunk > 0").withColumn("line", F.col("start") + F.sum(counts.cast("int")).over(within) - 1)
    return l.filter(F.col("t").startswith("+") & ~file_head).select("path", "line")


def _suffixes(path):
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def split_findings(f: DataFrame, changed: DataFrame) -> DataFrame:
    """f with in_diff: the finding's file is changed (equal path, or a suffix at a slash, in any case) and its line is added; no
    line, no patch and no changed file count as in. Every suffix of a finding's path is joined by equality."""
    paths = changed.select(F.lower("path").alias("suffix"), "path", F.col("patch").isNotNull().alias("has_patch")).dropDuplicates(["suffix"])
    keyed = f.select("id", "line_number", F.explode(_suffixes(F.col("file_path"))).alias("suffix")).join(paths, "suffix")
    hit = keyed.groupBy("id", "line_number").agg(F.min("path").alias("path"), F.max_by("has_patch", "path").alias("has_patch"))
    lines = added_lines(changed).withColumnRenamed("line", "line_number").distinct().withColumn("added", F.lit(True))
    verdict = hit.join(lines, ["path", "line_number"], "left").select("id", (F.coalesce("added", F.lit(False)) | ~F.col("has_patch") | F.col("line_number").isNull()).alias("v"))
    return f.join(verdict, "id", "left").withColumn("in_diff", F.coalesce("v", F.lit(True))).drop("v")


def resolve_paths(f: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, path) of the known files (path) whose path, in any case, is the end of the finding's at a slash, by equality on
    every suffix."""
    keyed = f.select("id", F.explode(_suffixes(F.col("file_path"))).alias("suffix"))
    return keyed.join(known.select(F.lower("path").alias("suffix"), "path").distinct(), "suffix").select("id", "path")


def inline_candidates(f: DataFrame, changed: DataFrame, most: int = 10) -> DataFrame:
    """The `most` riskiest findings that are critical or high, have a place, and lie in a changed file (path, patch) with a patch."""
    severe = f.filter(F.col("severity").isin("Critical", "High") & F.col("file_path").isNotNull() & F.col("line_number").isNotNull())
    patched = changed.filter("patch IS NOT NULL").select(F.col("path").alias("file_path")).distinct()
    return severe.join(patched, "file_path", "left_semi").orderBy(F.desc("risk"), "id").limit(most)
