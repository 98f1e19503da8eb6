"""A corpus of text files as DataFrames: discovery, exclusion, binary sniffing, languages, lines."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrid.functions.scores import cascade, contains_any, strip

# Excluded names, by substring of the lower-cased path or as suffix of "*...".
EXCLUDED = (
    ".git", "node_modules", "vendor", "target", "build", "dist", "__pycache__", ".tox", ".venv", "venv", ".env", ".env.example",
    "*.min.js", "*.min.css", "*.map", "*.bundle.js", "*.svg", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico",
    "*.woff", "*.woff2", "*.ttf", "*.eot", "*.lock", "package-lock.json", "yarn.lock", "cargo.lock", ".cargo",
)
# Language by extension.
LANGUAGES = (
    ("rust", ("rs",)), ("javascript", ("js", "jsx", "mjs", "cjs")), ("typescript", ("ts", "tsx", "mts", "cts")), ("python", ("py", "pyw")), ("go", ("go",)),
    ("ruby", ("rb",)), ("java", ("java",)), ("kotlin", ("kt", "kts")), ("swift", ("swift",)), ("c", ("c", "h")), ("cpp", ("cpp", "hpp", "cc", "cxx", "hh")),
    ("csharp", ("cs",)), ("php", ("php",)), ("shell", ("sh", "bash", "zsh", "fish")), ("yaml", ("yaml", "yml")), ("json", ("json",)), ("toml", ("toml",)),
    ("sql", ("sql",)), ("graphql", ("graphql", "gql")), ("protobuf", ("proto",)), ("vue", ("vue",)), ("svelte", ("svelte",)), ("html", ("html", "htm")),
    ("css", ("css", "scss", "less")), ("dart", ("dart",)), ("scala", ("scala",)), ("lua", ("lua",)), ("r", ("r", "rdata")),
)
BINARY_OVER, SNIFF = 10 * 1024 * 1024, 512
MAX_DEPTH = 30
#: Folders that hold no sources: the history, and the index that this library writes.
OWN_FOLDERS = (".git", ".findgrid")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; none for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def is_excluded(path: Column) -> Column:
    """By substring of the whole path, so src/builder.py is excluded for "build": the compat behaviour."""
    low = F.lower(path)
    out = contains_any(low, [x for x in EXCLUDED if x[0] != "*"])
    for x in EXCLUDED:
        if x[0] == "*":
            out = out | low.endswith(x[1:])
    return out


def is_excluded_strict(path: Column) -> Column:
    """By whole path segment or suffix."""
    low = F.lower(path)
    out = F.arrays_overlap(F.split(low, "/"), F.array(*(F.lit(x) for x in EXCLUDED if x[0] != "*")))
    for x in EXCLUDED:
        if x[0] == "*":
            out = out | low.endswith(x[1:])
    return out


def is_binary(content: Column) -> Column:
    """Empty, over 10 MB, or a zero byte among the first 512."""
    n = F.octet_length(content)
    return (n == 0) | (n > BINARY_OVER) | F.hex(F.substring(content, 1, SNIFF)).rlike("^(?:..)*?00")


def language(path: Column) -> Column:
    ext, name = extension(path), F.lower(file_name(path))
    by_name = cascade([((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile"), (name == "makefile", "makefile"), (name.endswith(".env"), "env")], None)
    return cascade([(ext.isin(*e), k) for k, e in LANGUAGES], by_name)


#: Extension lists: of the rule scan (by rule), anomaly scan, taint trace and import usage.
ANOMALY_EXTS = ("rs", "js", "jsx", "ts", "tsx", "py", "go", "rb", "java", "kt", "swift", "c", "cpp", "h", "hpp", "cs", "php")
TRACE_EXTS = ("rs", "js", "jsx", "ts", "tsx", "py", "go", "rb", "java", "php", "cs", "kt", "swift")
USAGE_EXTS = (*ANOMALY_EXTS, "vue", "svelte")


_LISTED = "path string, rel_path string, size long"


def _ignore_rules(text: str, at: str) -> list[tuple[str, bool, bool]]:
    """Rules (pattern of the path from the root, keep, folders only) of an ignore file in the folder `at` ("" or "a/b/")."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep or line.startswith(("\\#", "\\!")) else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        parts = re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^\]]+\])", line.lstrip("/"))
        rx = "".join({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(x) or (("[^" + x[2:] if x[1] == "!" else x) if x.startswith("[") else re.escape(re.sub(r"\\(.)", r"\1", x))) for x in parts)
        out.append((re.escape(at) + ("" if anchored else "(?:.*/)?") + rx + r"\Z", keep, folders))
    return out


def _is_ignored(rel: str, folder: bool, rules: list) -> bool:
    """The last rule that matches a path decides."""
    for rx, keep, only in reversed(rules):
        if (folder or not only) and re.match(rx, rel):
            return not keep
    return False


def _listing(fs, base: str, rel: str, rules: list | None, depth: int):
    """Files (path, rel_path, size) and folders (rel_path, rules) right below a folder, ignored ones left out (rules None: none)."""
    from pyarrow import fs as pafs

    found = fs.get_file_info(pafs.FileSelector(f"{base}/{rel}".rstrip("/")))
    for f in found:
        if rules is not None and f.base_name == ".gitignore" and f.type == pafs.FileType.File:
            with fs.open_input_stream(f.path) as r:
                rules = [*rules, *_ignore_rules(r.read().decode("utf-8", "replace"), rel)]
    files, folders = [], []
    for f in sorted(found, key=lambda f: f.base_name):
        at, folder = rel + f.base_name, f.type == pafs.FileType.Directory
        if at.count("/") + 1 <= depth and not _is_ignored(at, folder, rules or []):
            if folder and f.base_name not in OWN_FOLDERS:
                folders.append((at + "/", rules))
            elif not folder and f.type == pafs.FileType.File:
                files.append((f.path, at, int(f.size or 0)))
    return files, folders


def listing(spark: SparkSession, root: str, depth: int = MAX_DEPTH, gitignore: bool = True) -> DataFrame:
    """(path, rel_path, size) of all files below root, hidden ones and those that start with _ too, without those that a
    .gitignore above them names. Folders near the root are listed by the driver, each of the others by a task with all below
    it. root: a path or a URI that pyarrow's file systems reach from the executors (file, hdfs, s3, gs)."""
    from pyarrow import fs as pafs

    fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    files, todo = [], [("", [] if gitignore else None)]
    for _ in range(3):
        if len(todo) >= 256:
            break
        below = [_listing(fs, base, rel, rules, depth) for rel, rules in todo]
        files += [x for f, _ in below for x in f]
        todo = [x for _, d in below for x in d]
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for rel, rules in zip(b["rel"], b["rules"], strict=True):
                stack = [(rel, json.loads(rules))]
                while stack:
                    rel, rules = stack.pop()
                    files, folders = _listing(fs, base, rel, rules, depth)
                    stack += [x for x in folders]
                    yield pd.DataFrame([(p, r, n) for p, r, n in files], columns=["path", "rel_path", "size"])

    out = spark.createDataFrame(files, _LISTED)
    if todo:
        rest = spark.createDataFrame([(rel, json.dumps(rules)) for rel, rules in todo], "rel string, rules string").repartition(min(len(todo), 512))
        out = out.unionByName(rest.mapInPandas(run, _LISTED))
    return out


def walk(spark: SparkSession, root: str, most: int | None = None, depth: int = MAX_DEPTH, glob: str | None = None, gitignore: bool = True) -> DataFrame:
    """files (path, rel_path, ext, size, content) of the text files below root that are neither excluded nor ignored.

    Files are listed first; path rules and the size rule choose among them before a byte is read, and tasks read the rest.
    most: keep the first files by path (a limit asked for by the caller; none by default)."""
    f = listing(spark, root, depth, gitignore).filter(~is_excluded(F.col("rel_path")) & (F.col("size") > 0) & (F.col("size") <= BINARY_OVER))
    if glob:
        f = f.filter(file_name(F.col("rel_path")).rlike(fnmatch.translate(glob)))
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for p, r, n in zip(b["path"], b["rel_path"], b["size"], strict=True):
                with fs.open_input_stream(p) as s:
                    yield pd.DataFrame({"path": [p], "rel_path": [r], "size": [n], "content": [s.read()]})

    f = f.repartition(max(8, spark.sparkContext.defaultParallelism), F.xxhash64("rel_path")).mapInPandas(read, "path string, rel_path string, size long, content binary")
    f = f.filter(~is_binary(F.col("content")))
    f = f.select("path", "rel_path", extension(F.col("rel_path")).alias("ext"), "size", F.decode("content", "UTF-8").alias("content"))
    return f.orderBy("rel_path").limit(most) if most else f


def list_files(files: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` paths (1 to 1000), as a tool shows them."""
    return files.select("rel_path").orderBy("rel_path").limit(min(max(most, 1), 1000))


def numbered_file(files: DataFrame, path: str, start: int = 1, most: int = 100) -> DataFrame:
    """Rows (line_no, shown) of one file from line `start`, at most `most` (1 to 2000) and then a row that says how many follow.
    A path that is absolute or goes up is refused."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"refusing to read path outside the project: {path}")
    start, most = max(start, 1), min(max(most, 1), 2000)
    l = files.filter(F.col("rel_path") == path).select(split_lines(F.col("content")).alias("l"))
    end = F.least(F.lit(start - 1 + most), F.size("l"))
    shown = F.transform(F.slice("l", start, most), lambda x, i: F.struct((i + start).cast("long").alias("line_no"), F.concat(F.lpad((i + start).cast("string"), 6, " "), F.lit(" | "), x).alias("shown")))
    more = F.when(end < F.size("l"), F.array(F.struct((end + 1).cast("long").alias("line_no"), F.format_string("... (%d more lines — read_file with start_line=%d)", F.size("l") - end, end + 1).alias("shown"))))
    return l.select(F.inline(F.concat(shown, F.coalesce(more, F.array().cast("array<struct<line_no:bigint,shown:string>>")))))


def split_lines(text: Column, feeds_only: bool = False) -> Column:
    """Lines without their ends; a final line end adds no empty line. feeds_only: lines end at line feeds alone, carriage returns
    stay in them, and an empty text is one empty line."""
    if feeds_only:
        return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    l = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    return F.when(F.element_at(l, -1) == "", F.slice(l, 1, F.greatest(F.size(l) - 1, F.lit(0)))).otherwise(l)


def lines(files: DataFrame) -> DataFrame:
    """lines (path, ext, line_no, line), numbered from 1."""
    return files.select("path", "ext", F.posexplode(split_lines(F.col("content"))).alias("i", "line")).select("path", "ext", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def search_lines(l: DataFrame, pattern: str, ignore_case: bool = True, path_part: str | None = None, most: int | None = 500) -> DataFrame:
    """path:line: text of the lines that have the pattern, in files whose path contains path_part; the first `most` by place."""
    hit = l.filter(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern))
    if path_part:
        hit = hit.filter(F.col("path").contains(path_part))
    hit = hit.select("path", "line_no", F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), strip(F.col("line"))).alias("hit"))
    return hit.orderBy("path", "line_no").limit(most) if most else hit


def path_depth_cap(f: DataFrame, most: int) -> DataFrame:
    """The first `most` files of each project by path."""
    return f.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy("path"))).filter(F.col("_n") <= most).drop("_n")
